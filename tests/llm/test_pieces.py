import random

import pytest

from scriptorium.llm import pieces, tokens


@pytest.fixture(scope="module")
def cutter(spark):
    return pieces.Cutter(tokens.public(spark).encoder())


def essay(seed, sentences=120):
    rng = random.Random(seed)
    words = "time river stone garden letter window because under after green quiet seldom morning answer".split()
    out = []
    for i in range(sentences):
        out.append(" ".join(rng.choice(words) for _ in range(rng.randint(4, 14))).capitalize() + rng.choice([".", "!", "?"]))
        out.append("\n\n" if i % 7 == 6 else " ")
    return "".join(out)


def check(cutter, text, limit):
    found = cutter.cut(text, limit)
    ids = cutter.encoder.encode(text)
    assert found[0][0] == 0 and found[-1][0] + found[-1][1] == len(ids)
    for (a, n, *_), (b, *_) in zip(found, found[1:]):
        assert b <= a + n and 0 <= (a + n - b) - limit.overlap <= 3
    for first, n, begin, end, _ in found:
        assert 0 < n <= limit.max_tokens and cutter.encoder.count(text[begin:end]) <= limit.max_tokens
    return found


@pytest.mark.parametrize("limit", [pieces.Limit(1, 64, 8), pieces.Limit(2, 100, 0), pieces.Limit(3, 20, 9)])
def test_cover_limit_overlap(cutter, limit):
    for seed in range(4):
        found = check(cutter, essay(seed), limit)
        assert {kind for *_, kind in found[:-1]} <= {"paragraph", "sentence", "word", "line"}


def test_unbroken_and_odd(cutter):
    limit = pieces.Limit(1, 50, 10)
    for text in ("x" * 5000, "日本語の文章" * 300, "🇩🇪" * 400, " " * 3000, "a\r\nb" * 300, "\n" * 500):
        check(cutter, text, limit)
    assert cutter.cut("", limit) == [] and len(cutter.cut("short", limit)) == 1


def test_edits_stay_local(cutter):
    limit = pieces.Limit(1, 64, 0)
    text = essay(9, 400)
    edited = text[:1000] + " An inserted sentence of some words." + text[1000:]
    one = {text[b:e] for _, _, b, e, _ in cutter.cut(text, limit)}
    two = {edited[b:e] for _, _, b, e, _ in cutter.cut(edited, limit)}
    assert len(two - one) <= 6


def test_limits():
    with pytest.raises(ValueError):
        pieces.Limit(1, 10, 5)


def test_rows(spark):
    df = spark.createDataFrame([(1, essay(1), "x"), (1, essay(1), "y"), (2, None, "z"), (3, "", "z")], "piece_no int, piece string, n_tokens string")
    got = pieces.pieces(df, "piece_no", "piece", [pieces.Limit(1, 64, 8)], tokens.public(spark))
    counts = {(r.id, r.piece_no): r["count"] for r in got.groupBy("id", "piece_no").count().collect()}
    assert set(counts.values()) == {2} and {k[0] for k in counts} == {1}
    assert pieces.pieces(df.limit(0), "piece_no", "piece", [pieces.Limit(1, 64, 8)], tokens.public(spark)).collect() == []


def test_an_edit_alters_near_pieces_at_the_tables_overlap(cutter):
    """With an overlap as in piece_limit: pieces away from the edit keep their texts."""
    text = essay(5, 400)
    at = text.index(". ", len(text) // 2) + 2
    changed = text[:at] + "An entirely new sentence stands here now. " + text[at:]
    for limit in (pieces.Limit(1, 64, 8), pieces.Limit(2, 128, 16), pieces.Limit(3, 64, 0)):
        a = [text[b:e] for *_, b, e, _ in check(cutter, text, limit)]
        b = [changed[b:e] for *_, b, e, _ in check(cutter, changed, limit)]
        same = len(set(a) & set(b))
        assert same >= 0.8 * len(a), (limit, same, len(a))
