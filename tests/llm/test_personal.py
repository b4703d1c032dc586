import re

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import personal

NAMES = [("g", n) for n in "Anna Björn Mark May Will Rose Hope Frank Peter".split()] + [("f", n) for n in ["Thalelby", "de la Torvena", "D’Ambrieux", "O'Dranley", "Kestrow-Vale"]]
LEXICON = personal.Lexicon.of(NAMES)


def found(text):
    return [(("name" if k == "given" else k), text[s:e]) for s, e, k in personal.find_items(text, LEXICON)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Write to <a.b+c@mail.x.test> or mailto:d@y.example.", [("email", "a.b+c@mail.x.test"), ("email", "d@y.example")]),
        ("bjoern (at) quill (dot) example, todd AT fern DOT test, irene.v[at]tide.example.", [("email", "bjoern (at) quill (dot) example"), ("email", "todd AT fern DOT test"), ("email", "irene.v[at]tide.example")]),
        ("The file logo@2x.png is 65 KB. We ordered 5 @ 38 each.", []),
        ("Call +44 (0)20 7946 0193 or (512) 555-0166 ext. 49, 030/23125-143, 01.99.00.79.68.", [("phone", "+44 (0)20 7946 0193"), ("phone", "(512) 555-0166 ext. 49"), ("phone", "030/23125-143"), ("phone", "01.99.00.79.68")]),
        ("tel.0049 30 23125197, 1-617-555-0161", [("phone", "0049 30 23125197"), ("phone", "1-617-555-0161")]),
        ("PO 4590-2671, ticket 8854783, tracking code 00276655175318, score 19-78-41, 192.0.2.86, 2023-03-05 15:31, INV-2024-43739, room 12-226", []),
        ("SSN 912-86-1865, NI number QQ 06 29 95 D, DNI: 84572285-C, tax ID 76 099 060 198, NIR 2 58 07 99 351 020 49.", [("id_number", x) for x in ("912-86-1865", "QQ 06 29 95 D", "84572285-C", "76 099 060 198", "2 58 07 99 351 020 49")]),
        ("Flat 30, 465 Harrow Street, Stanwick; 371 Wrenfold Ave..", [("address", "Flat 30, 465 Harrow Street"), ("address", "371 Wrenfold Ave.")]),
        ("The venue is 156 Mosswell Rd. It is 84, rue des Tanneurs-Verts, PO Box 4949.", [("address", "156 Mosswell Rd"), ("address", "84, rue des Tanneurs-Verts"), ("address", "PO Box 4949")]),
        ("Plaza de los Cerezales 59, 3º B, Montelune und Lindenauer Str. 169a.", [("address", "Plaza de los Cerezales 59, 3º B"), ("address", "Lindenauer Str. 169a")]),
        ("The Thornwick Avenue launch drew 93 visitors.", []),
        ("Dear Mr. Thalelby, ask Anna K. de la Torvena or Thalelby, Peter.", [("name", "Thalelby"), ("name", "Anna K. de la Torvena"), ("name", "Thalelby, Peter")]),
        ("Thalelby & Sons has sent it. Thalelby GmbH too. cc S. D’Ambrieux for info.", [("name", "S. D’Ambrieux")]),
        ("Mark my words, May is too late. Will you mark the date and hope for sun? Hope this helps. Frank feedback is welcome until May 19.", []),
        ("Hi May,\nWill will look at it. Call Rose on it.\nMark", [("name", "May"), ("name", "Will"), ("name", "Rose"), ("name", "Mark")]),
        ("ANNA KESTROW-VALE and Björn O'Dranley’s", [("name", "ANNA KESTROW-VALE"), ("name", "Björn O'Dranley")]),
        ("", []),
    ],
)
def test_items(text, want):
    assert found(text) == want


def test_learning(spark):
    rows = [('"de la Torvena, Ylva" <a@b.test>; Max R. Müller <m@x.test>',), ("x@y.test (Zoë Ash)",), (None,), ("plain@y.test",), ("",)]
    names = personal.learn_names(spark.createDataFrame(rows, "address string"), spark.createDataFrame([("Ada",), ("Ada",), (None,)], "given_name string"))
    assert {tuple(r) for r in names.collect()} == {("g", "Ylva"), ("f", "de la Torvena"), ("g", "Max"), ("f", "Müller"), ("g", "Zoë"), ("f", "Ash"), ("g", "Ada")}


def mails(spark):
    rows = [("1", "Dear Anna,\ncall 512-555-0156 or Peter Thalelby.", None, "Anna de la Torvena <a@x.test>", 7), ("2", "", "Re: Anna", None, 8), ("3", "none here", "x", "a@x.test", 9)]
    return spark.createDataFrame([*rows, rows[0]], "id string, body string, subject string, to_addr string, field int")


FIELDS = ["body", "subject", "to_addr"]


def names(spark):
    return spark.createDataFrame(NAMES, "kind string, name string")


def test_rows_and_large_lexicon(spark, monkeypatch):
    get = lambda: sorted((r.id, r.field, r.kind, r.found_text) for r in personal.items(mails(spark), "id", FIELDS, names(spark)).collect())
    want = get()
    assert len(want) == 2 * 5 + 2
    monkeypatch.setattr(personal, "MAX_NAMES", 3)
    assert get() == want
    assert personal.items(mails(spark).limit(0), "id", FIELDS, names(spark)).collect() == []


def test_replacements(spark):
    done = personal.replaced(mails(spark), FIELDS, names(spark), b"k").orderBy("id").collect()
    assert len(done) == 4 and done[-1].body == "none here" and done[-1].field == 9 and done[2].body == ""
    assert done[0].body == done[1].body and done[0].body.startswith("Dear [NAME_") and "[PHONE_" in done[0].body
    made = personal.replaced(mails(spark), FIELDS, names(spark), b"k", "surrogate").where("id = '1'").first()
    given = made.body.split(",")[0].removeprefix("Dear ")
    assert made.to_addr.startswith(given + " de la ") and given != "Anna"  # the same person under one name
    assert [len(x) for x in made.body.split("call ")[1].split(" ")[0].split("-")] == [3, 3, 4]
    assert personal.replaced(mails(spark), FIELDS, names(spark), b"other").where("id = '1'").first().body != done[0].body


def salts_of(df) -> dict:
    return {(r.kind, r["item"]): r.salt for r in df.collect()}


def test_collisions(spark):
    """Items whose surrogates meet get salts, those that don't get none; other keys give others."""
    rows = spark.createDataFrame([("phone", f"5-{i:02d}", False) for i in range(40)], "kind string, found_text string, alone boolean")
    salts = salts_of(personal.collisions(rows, b"k"))
    assert 0 < len(salts) < 40
    assert len({personal.surrogate(b"k", "phone", f"5-{i:02d}", salts) for i in range(40)}) == 40
    assert personal.surrogate(b"k", "phone", "512-555-0101") != personal.surrogate(b"j", "phone", "512-555-0101")


def test_salts_beyond_the_broadcast(spark, monkeypatch):
    """With more salts and names than may be broadcast each row gets its own, and the same text comes out."""
    texts = [f"Hi Anna, call 5-{i:02d}5-555-0{i:03d} or {chr(97 + i % 26)}@b{i % 3}.test. Peter Thalelby, PO Box {i % 90 + 10}" for i in range(60)]
    df = spark.createDataFrame([(str(i), t, None, None) for i, t in enumerate(texts)], "id string, body string, subject string, to_addr string")
    lexicon = names(spark)
    salts = personal.collisions(personal.items(df, "id", FIELDS, lexicon), b"k")
    assert salts.count() > 3
    get = lambda: sorted(tuple(r) for r in personal.replaced(df, FIELDS, lexicon, b"k", "surrogate", salts).select("id", "body").collect())
    want = get()
    monkeypatch.setattr(personal, "MAX_NAMES", 3)
    assert get() == want and all("Thalelby" not in t for _, t in want)


def test_gender_and_script():
    assert [personal.gender(w) for w in ("Luca", "Henry", "George", "Denis", "Carmen", "Ingrid", "Anna", "Paolo", "Qwex")] == ["m"] * 4 + ["f"] * 3 + ["m", ""]
    made = personal.surrogate(b"k", "name", "Анна Каренина")
    assert made != "Анна Каренина" and re.fullmatch(r"[А-Я][а-я]+ [А-Я][а-я]+", made)
    assert re.fullmatch(r"[Α-Ω][α-ω]+", personal.surrogate(b"k", "name", "Παπαδοπούλου"))
    lexicon = personal.Lexicon.of([("g", "Анна"), ("f", "Каренина")])
    assert [k for *_, k in personal.find_items("Письмо от Анна Каренина.", lexicon)] == ["name"]


def test_mail_surrogates_keep_their_form():
    for text, form in [
        ("jo.doe+x1@mail.host.test", r"[a-z]{2}\.[a-z]{3}\+[a-z]\d@[a-z]{4}\.[a-z]{4}\.example"), ("jo (at) host (dot) test", r"[a-z]{2} \(at\) [a-z]{4} \(dot\) example"), ("Jo AT host DOT test", r"[A-Z][a-z] AT [a-z]{4} DOT example"),
    ]:
        made = personal.surrogate(b"k", "email", text)
        assert re.fullmatch(form, made), made


def test_surrogates_keep_form():
    s = lambda kind, text: personal.surrogate(b"k", kind, text)
    assert s("phone", "+44 (0)20 7946 0193").startswith("+44 (") and s("id_number", "QQ559489A")[2:8].isdigit()
    assert s("name", "ANNA THALELBY").isupper() and "," in s("name", "Thalelby, Anna") and s("email", "a@b.test").endswith(".example")
    assert s("address", "371 Wrenfold Ave.").endswith(" Ave.") and s("address", "371 Wrenfold Ave.") != "371 Wrenfold Ave."
    assert s("given", "Anna") == s("name", "Anna Thalelby").split()[0] == s("given", "Anna")


@pytest.mark.parametrize(
    "text,kept,gone",
    [
        ("Mühlbachstraße 13", r"\w+straße \d\d", "Mühlbach"),
        ("Lindenauer Str. 169a, 2. OG", r"\w+ Str\. \d{3}[a-z], \d\. OG", "Lindenauer"),
        ("An der Wiese 4", r"An der \w+ \d", "Wiese"),
        ("172, avenue de la Fontaine Bleue", r"\d{3}, avenue de la \w+ \w+", "Fontaine Bleue"),
        ("84, rue des Tanneurs-Verts, 3e étage", r"\d\d, rue des \w+, \de étage", "Tanneurs Verts"),
        ("9 rue de l’Église", r"\d rue de l’\w+", "Église"),
        ("Calle Mayor 5", r"Calle \w+ \d", "Mayor"),
        ("Plaza de los Cerezales 59, 3º B", r"Plaza de los \w+ \d\d, \dº [A-Z]", "Cerezales"),
        ("12 Old Mill Road", r"\d\d \w+ \w+ Road", "Old Mill"),
        ("5 Elm St", r"\d \w+ St", "Elm"),
        ("9 Oak Road, Flat 3B", r"\d \w+ Road, Flat \d[A-Z]", "Oak"),
        ("Flat 30, 465 Harrow Street", r"Flat \d\d, \d{3} \w+ Street", "Harrow"),
        ("PO Box 4949", r"PO Box \d{4}", "4949"),
    ],
)
def test_streets_are_replaced(text, kept, gone):
    assert found(text) == [("address", text)]
    made = personal.surrogate(b"k", "address", text)
    assert re.fullmatch(kept, made), made
    assert not any(w.casefold() in made.casefold() for w in gone.split())


def test_no_surrogate_is_shared(spark):
    """More names than the given and family names' space has, and short numbers that fill theirs."""
    syllables = [a + b for a in "bcdfghjklmnprstvwz" for b in "aeiou"]
    words = ["Q" + a + b for a in syllables for b in syllables]
    given, family = words[:1000], words[-6000:]
    people = [f"{given[i % 1000]} {f}" for i, f in enumerate(family)] + [f"{family[0]}, {given[1]}"] + [f"{c}. {family[7]}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    rows = [("name", p, False) for p in people] + [("name", g, True) for g in given] + [("name", f, False) for f in family]
    rows += [("address", f"PO Box {i}", False) for i in range(1, 100)] + [("phone", f"555-{i:04d}", False) for i in range(2000)]
    salts = salts_of(personal.collisions(spark.createDataFrame(rows, "kind string, found_text string, alone boolean"), b"k"))
    made = lambda kind, text: personal.surrogate(b"k", kind, text, salts)
    items = {("given" if alone else kind, text) for kind, text, alone in rows}
    for kinds in (("name", "given"), ("address",), ("phone",)):
        own = [x for x in items if x[0] in kinds]
        assert len({personal.canonical(kinds[0], made(*x)) for x in own}) == len({personal.canonical(*x) for x in own})
    for i, f in enumerate(family):  # parts of a name stay parts of it
        assert made("name", f"{given[i % 1000]} {f}") == f"{made('given', given[i % 1000])} {made('name', f)}"
    assert made("name", f"{family[0]}, {given[1]}") == f"{made('name', family[0])}, {made('given', given[1])}"


def test_placeholder_codes_are_long(spark):
    body = personal.replaced(mails(spark), FIELDS, names(spark), b"k").where("id = '1'").first().body
    assert all(len(code) >= 16 for code in re.findall(r"\[[A-Z]+_(\w+)\]", body)) and "[NAME_" in body


@pytest.mark.parametrize("text", ["see Thalelby’s plan", "Thalelby's own", "Bye\n-Anna", "Bye\nAnna-", "Dear Anna-Peter,", "Dear ANNA-PETER,", "ask d'Anna now", "GROSSELBY called", "de la Torvena-", "O'Dranley’s and Kestrow-Vale's"])
def test_large_lexicon_reads_words_alike(spark, monkeypatch, text):
    df = spark.createDataFrame([("1", text, None, None)], "id string, body string, subject string, to_addr string")
    lexicon = names(spark).union(spark.createDataFrame([("f", "Großelby")], "kind string, name string"))
    get = lambda: sorted((r.start, r.end, r.kind, r.alone) for r in personal.items(df, "id", FIELDS, lexicon).collect())
    want = get()
    assert want
    monkeypatch.setattr(personal, "MAX_NAMES", 3)
    assert get() == want
    assert personal.replaced(df, FIELDS, lexicon, b"k").first().body != text
