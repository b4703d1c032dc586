import datetime as dt
import random

import pytest

from scriptorium.llm import newtext
from scriptorium.llm.automaton import SuffixAutomaton

SCHEMA = "item string, field string, thread string, sender string, at timestamp, text string, line_no int"


def marked(text):
    _, marks = newtext.structure(text)
    return "".join(m or "." for m in marks)


def test_marks():
    assert marked("Hi,\n\nyes.\n\nOn Tue, Jan 6, 2023 at 17:47, A B\n<a@b.test> wrote:\n> old\n> > older\n\nmore") == "....." [:4] + "qqqq.."
    assert marked("Hi\n\nBest,\nAnn\n\n-- \nAnn Lee\nCEO, Firm Group\nT: 206 555 0141") == "....." + "ssss"
    assert marked("Hi\n\n-A\nEditor, Firm Labs\nT: +1 206 555 0141\nwww.firm.test\n\nThis message is meant only for the addressee; no contract is formed.") == "...sss.d"
    assert marked("Hi\n\nAnn Lee | Editor | Firm Labs | 206 555 0141") == "..s"
    assert marked("ok\n\nFrom: A <a@b.test>\nSent: now\nTo: B\nSubject: x\n\nold\nold") == ".." + "q" * 7
    assert marked("ok\nSent from my phone") == ".s"
    assert marked("Antwort\n\nAm 18.03.2023 um 03:11 schrieb A B:\n| alt") == "..qq"


def test_what_looks_like_quotes():
    for text in (
        "> 51% growth would be the dream, honestly.\nBye", "| item | days |\n| print | 17 |", "On Monday I wrote to the price people, and they agreed.", "On Friday the printer wrote:\nnothing at all.",
        "Slots:\nFrom: 9:00\nTo: 11:30", "This message is confidential only until the launch, so keep it in the team.\n\nBest,\nAnn", "-- pricing first, then the rest --\n\nBye",
    ):
        assert set(marked(text)) == {"."}, text


def test_automaton_equals_search():
    rng = random.Random(2)
    for _ in range(60):
        texts = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(3)]
        query = [rng.choice("abcd") for _ in range(20)]
        automaton = SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        runs = {tuple(t[i : i + 3]) for t in texts for i in range(len(t) - 2)}
        want = [any(tuple(query[k : k + 3]) in runs for k in range(max(0, i - 2), min(i, len(query) - 3) + 1)) for i in range(len(query))]
        assert automaton.inherited(query, 3) == want


OLD = "the quick report about the autumn figures needs one more careful look by somebody from the other team before Friday"


def thread(spark, n=1):
    at = dt.datetime(2024, 1, 1)
    rows = [("m1", "body", "t", "ann", at, f"Hello Bob\n{OLD}\nfresh words only here", 1), ("m2", "body", "t", "bob", at + dt.timedelta(1), "My answer\n" + OLD.replace(" needs", "\nneeds") + "\nand that is new", 1)]
    rows += [(f"f{i}", "body", "t", "cy", at + dt.timedelta(2), f"filler number {i}", 1) for i in range(n)]
    rows += [("n", "body", None, None, None, None, 1), ("e", "body", "t", "ann", at, "", 1), ("m1", "body", "t", "ann", at, f"Hello Bob\n{OLD}\nfresh words only here", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_inherited_in_thread(spark):
    got = {(r.item, r.line_no, r.reason) for r in newtext.old_lines(thread(spark)).collect()}
    assert got == {("m2", 2, "t"), ("m2", 3, "t")}


def random_threads(seed):
    """Threads whose messages repeat pieces of each other, quoted or not, with null times and senders, ties, and items that come twice."""
    rng = random.Random(seed)
    at = dt.datetime(2024, 1, 1)
    pieces = [" ".join(f"p{k}w{i}" for i in range(rng.choice([6, 12, 13, 25]))) for k in range(12)]
    rows = []
    for n in range(60):
        lines = []
        for piece in rng.sample(pieces, rng.randint(1, 4)):
            w = piece.split()
            cut = rng.randint(0, len(w))
            mark = rng.choice(["", "", "", "> "])
            lines += [mark + " ".join(w[:cut]), mark + " ".join(w[cut:])] if rng.random() < 0.5 else [mark + piece]
        when = rng.choice([None, *(at + dt.timedelta(k) for k in range(5))])
        rows.append((f"m{n}", "body", f"t{n % 5}", rng.choice([None, "ann", "bob", "cy"]), when, f"Own words {n}\n" + "\n".join(lines), 1))
    return rows + [(*rows[7][:5], "another text\n" + rows[9][5], 1)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_both_ways_find_the_same(spark, seed):
    df = spark.createDataFrame(random_threads(seed), SCHEMA)
    want = {tuple(r) for r in newtext.old_lines(df).collect()}
    assert {tuple(r) for r in newtext.old_lines(df, (1, 1)).collect()} == want
    assert {tuple(r) for r in newtext.old_lines(df, (10**6, 500)).collect()} == want
    assert sum(r[3] == "t" for r in want) > 10


def test_standing_endings(spark):
    rows = [(f"i{k}", "body", None, "ann", None, f"Text number {k}, as said.\n\nAnn\nOffice hours 9 to 5; room 12", 1) for k in range(4)]
    got = {(r.item, r.line_no, r.reason) for r in newtext.old_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(f"i{k}", 4, "r") for k in range(4)}
    assert newtext.old_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_endings_below_the_name(spark):
    """A notice of whole sentences in all of a sender's messages; not what stands above the name, nor copies of one message."""
    notice = "All offers are subject to contract.\nPlease think of the trees, and of " + "very " * 30 + "long lines."
    rows = [(f"i{k}", "body", None, "ann", None, f"Text number {k} is new.\nThe same sentence ends every one.\nNo. {k}!\n\nBest,\nAnn\n\n{notice}", 1) for k in range(3)]
    rows += [(f"c{k}", "body", None, "bob", None, f"Number {k}\nOne text sent again and again.\n\nBob\nIt has a line down here.", 1) for k in range(5)]
    got = {(r.item, r.line_no, r.reason) for r in newtext.old_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(f"i{k}", n, "r") for k in range(3) for n in (8, 9)}


def test_owners_of_runs():
    rng = random.Random(4)
    for _ in range(60):
        texts = [([rng.choice("abc") for _ in range(rng.randint(0, 12))], rng.choice("xyz")) for _ in range(rng.randint(1, 6))]
        automaton = SuffixAutomaton()
        for t, who in texts:
            automaton.add(t, who)
        query, me = [rng.choice("abc") for _ in range(15)], rng.choice("xyz")
        runs = {tuple(t[i : i + 3]) for t, who in texts if who != me for i in range(len(t) - 2)}
        want = [any(tuple(query[k : k + 3]) in runs for k in range(max(0, i - 2), min(i, len(query) - 3) + 1)) for i in range(len(query))]
        assert automaton.inherited(query, 3, me) == want


def test_large_threads_inherit_alike(spark):
    """A-B-A threads, null times and senders, equal times, an item that comes twice."""
    at = dt.datetime(2024, 1, 1)
    text = lambda k: " ".join(f"{w}{k}" for w in OLD.split())
    sent = [
        ("a", [("ann", 1), ("bob", 2), ("ann", 3), ("bob", 4)]), ("b", [("cy", None), ("ann", 1), ("bob", 2)]), ("c", [("ann", 1), ("bob", 1), ("cy", 1)]),
        ("d", [("ann", None), ("bob", None)]), ("e", [(None, 1), ("ann", 2), (None, 3)]), ("f", [("ann", 1), (None, 2), (None, 3)]), ("g", [("ann", 1), ("ann", 2)]),
    ]
    rows = [(f"{k}{n}", "body", "t", who, when and at + dt.timedelta(when), f"Number {k} {n}\n{text(k)}", 1) for k, messages in sent for n, (who, when) in enumerate(messages)]
    rows += [("a0", "body", "t", "ann", at + dt.timedelta(1), f"zzz\n{text('g')}", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    get = lambda most: {(r.item, r.line_no, r.reason) for r in newtext.old_lines(df, most).collect()}
    want = get((500, 10**6))
    assert {i for i, _, _ in want} == {"a1", "a2", "a3", "b0", "b2", "c1", "c2", "d1", "e1", "e2", "f1", "f2"}
    assert get((3, 10**6)) == want
