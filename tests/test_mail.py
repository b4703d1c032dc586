from pyspark.sql import functions as F

from scriptorium.operators import mail, style

SCHEMA = "id string, subject string, body string, from_addr string, to_addr string, internal_date string, reason_ int"
LONG = "This is a text that goes on for more than a hundred characters, so that it is not too short to be accepted at all."


def mails(spark, *rows):
    return spark.createDataFrame([(r.get("id", str(i)), r.get("subject"), r.get("body"), r.get("from_addr"), r.get("to_addr"), r.get("internal_date"), i) for i, r in enumerate(rows)], SCHEMA)


def test_reasons(spark):
    many = ", ".join(f"p{i}@x.test" for i in range(24))
    rows = [
        ({"body": LONG}, ""), ({"body": None}, "empty_body"), ({"body": " \n "}, "empty_body"), ({"body": "Thanks!"}, "too_short"), ({"body": LONG, "subject": "Fwd: news"}, "forward"),
        ({"body": LONG, "subject": "Out of Office"}, "auto_reply"), ({"body": LONG, "subject": "Accepted: lunch"}, "calendar_response"), ({"body": LONG, "to_addr": many}, "mass_email"),
        ({"body": "Yes.\nOn Monday, A wrote:\n> " + LONG}, "too_short"),
    ]
    got = [r.reason for r in mail.accept(mails(spark, *(r for r, _ in rows))).orderBy("reason_").collect()]
    assert got == [reason for _, reason in rows]


def test_boundaries(spark):
    got = spark.range(1, 101).select("id", mail.recipient_type(F.col("id")).alias("t")).where("id in (1, 2, 5, 6, 15, 16, 100)").orderBy("id").collect()
    assert [r.t for r in got] == ["individual", "small_group", "small_group", "team", "team", "broadcast", "broadcast"]
    rows = [{"internal_date": "1704704400000"}, {"internal_date": "1704722400000"}, {"internal_date": "0"}, {"internal_date": "soon"}, {}]
    got = mail.enrich(mails(spark, *rows)).orderBy("reason_").collect()
    assert [r.time_of_day for r in got] == ["morning", "afternoon", "unknown", "unknown", "unknown"]
    assert [r.audience for r in got] == ["unknown"] * 5


def test_structure_and_reply(spark):
    body = "Hi Ann,\n\nfirst\nsecond\n\n• a\n• b\n• c\n\n-John"
    r = mail.structure(mails(spark, {"body": body}, {})).orderBy("reason_").collect()
    assert (r[0].paragraph_count, r[0].bullet_count, r[0].greeting, r[0].closing) == (4, 3, "Hi Ann,", "-John")
    assert (r[1].char_count, r[1].greeting, r[1].closing) == (0, None, None)
    body = "Yes, it's fine.\n\nOn Mon, A wrote:\n> one\n\n> two\nwrapped\n\nBye"
    r = mail.split_reply(mails(spark, {"body": body}, {})).orderBy("reason_").collect()
    assert r[0].quoted_text == "one\n\ntwo\nwrapped" and r[0].reply_text == "Yes, it's fine.\n\n\nBye"
    assert r[1].quoted_text == "" and r[1].reply_text == ""
    hints = mails(spark, {"body": "It’s wonderful, hey you"}).select(mail.tone_hints(F.col("body")).alias("h")).first().h
    assert hints == ["casual", "warm", "concise", "uses_contractions"]


def test_style_groups(spark):
    df = mails(spark, {"id": "a", "body": "Hi Ann,\n\nThis is one sentence here. And this is another!\n\nThanks,\nBob"}, {"id": "a", "body": None}, {"id": "b", "body": ""})
    r = style.rhythm(df, "id").collect()
    assert [(x.id, x.avg_words_per_sentence, x.visual_density) for x in r] == [("a", 4.5, "low")]
    assert {(x.id, x.greeting, x.is_primary) for x in style.greetings(df, "id").collect()} == {("a", "Hi {name},", True)}
    assert {(x.id, x.closing) for x in style.closings(df, "id").collect()} == {("a", "Thanks,")}
    assert {(x.id, x.avg_paragraphs_per_email) for x in style.formatting(df, "id").collect()} == {("a", 3.0), ("b", 0.0)}
    empty = df.limit(0)
    for f in (style.rhythm, style.formatting, style.greetings, style.closings, style.subjects, style.mechanics, style.signature_blocks):
        assert f(empty, "id").collect() == []


def test_seniority(spark):
    see = lambda to, sig, sender, body, aud: spark.range(1).select(mail.seniority(*(F.lit(x) for x in (to, sig, sender, body, aud)))).first()[0]
    assert see("j@x.test", "John Smith, CEO", "a@x.test", "", None) == "executive"
    assert see("j@y.test", "", "a@x.test", "", "") == "external_client"
    assert see("j@x.test", "", "a@x.test", "The interview went well", "internal") == "candidate"
    assert see("j@x.test", "", "a@x.test", "", "") == "unknown"
    assert see("", "", "", "", "") == "peer"
