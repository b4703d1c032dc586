import random

import numpy as np
import pytest

from scriptorium.llm import near
from scriptorium.llm.words import shingles, words


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(15, 70))]
        rows.append((f"d{i}", " ".join(base)))
        for k in range(rng.randint(0, 3)):
            edited = list(base)
            for _ in range(rng.randint(1, 8)):
                at = rng.randrange(len(edited))
                edited[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            rows.append((f"d{i}_{k}", "  ".join(edited).upper() + "!"))
    common = " ".join(f"c{i}" for i in range(25))
    rows += [(f"h{i}", common + " " + " ".join(rng.choice(vocabulary) for _ in range(6))) for i in range(25)]
    return [*rows, ("n", None), ("e", ""), ("s", "too short"), ("d0", rows[0][1]), ("copy", rows[0][1].upper()), (None, "x " * 30)]


def brute(rows, similarity, size, least):
    sets = {}
    for i, t in rows:
        if i is not None and t is not None and len(words(t)) >= least:
            sets.setdefault(i, []).append(set(shingles(words(t), size).tolist()))
    ids = sorted(sets)
    out = set()
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(len(x & y) >= similarity * len(x | y) and x for x in sets[a] for y in sets[b]):
                out.add((a, b))
    return out


@pytest.mark.parametrize("similarity,size,least", [(0.6, 3, 20), (0.8, 5, 10), (0.55, 2, 5)])
def test_equals_brute_force(spark, similarity, size, least):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "b string, a string, cls string, size int")
    got = {tuple(r) for r in near.near_pairs(df, "b", "a", similarity, size, least).collect()}
    assert got == brute(rows, similarity, size, least) and got


def boilerplate():
    """Texts with a disclaimer of varying weight, some of them near-copies: hot chains, heavy classes and boilerplate-dominated ones."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(400)]
    notice = " ".join(f"n{i}" for i in range(30))
    rows = []
    for i in range(60):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([4, 25, 60, 120]))]
        rows.append((f"b{i}", " ".join(own) + " " + notice))
        if i % 3 == 0:
            own[rng.randrange(len(own))] = "edit"
            rows.append((f"b{i}_e", notice + " " + " ".join(own)))
    return rows


LIMITS = [near.Limits(hot=5), near.Limits(hot=5, sample=20, frequent=4), near.Limits(hot=3, bucket=40), near.Limits(hot=5, sample=1, frequent=1)]


@pytest.mark.parametrize("limits", LIMITS)
def test_hot_chains_lose_no_pair(spark, limits):
    rows = boilerplate() + corpus(9)[:60]
    df = spark.createDataFrame(rows, "id string, body string")
    got = {tuple(r) for r in near.near_pairs(df, "id", "body", 0.6, 3, 20, limits).collect()}
    assert got == brute(rows, 0.6, 3, 20) and len(got) > 30


def test_groups(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id string, body string")
    pairs = brute(rows, 0.6, 3, 20)
    group = {r.id: r.group for r in near.near_groups(df, "id", "body", 0.6, 3, 20).collect()}
    assert all(group[a] == group[b] for a, b in pairs)
    parent = {i: i for i in group}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[top(a)] = top(b)
    assert len({top(i) for i in group if group[i] is not None}) - len(set(group.values())) in (0,)


def test_empty_and_bad(spark):
    df = spark.createDataFrame([], "id string, body string")
    assert near.near_pairs(df, "id", "body").collect() == [] and near.near_groups(df, "id", "body").collect() == []
    with pytest.raises(ValueError):
        near.near_pairs(df, "id", "body", similarity=0.5)


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.cls: r.group for r in near.components(links).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43


def test_shingles_are_sorted_sets():
    s = shingles("a b c a b c a".split(), 3)
    assert len(s) == 3 and (np.diff(s.astype(object)) > 0).all() and len(shingles(["a"], 3)) == 0
