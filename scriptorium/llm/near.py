"""Near-duplicate texts: a pigeonring filter over the Hamming distance of word-run sets.

A text is the set of its distinct runs of `size` words. A pair of Jaccard similarity s or
more, with union U, differs in D <= (1 - s) U elements. Put the union's elements on a ring
in the order of their hashes, each a box that holds 1 where the texts differ. The
pigeonring principle asks for a chain of boxes whose cumulative differences stay within
the proportional budget at each length: a chain of two has budget 2 (1 - s), which is
below one for s > 0.5, so it holds no difference, and the two elements stand side by side
in the rings of both texts; a chain of four has budget below two, so of the next two boxes
one at least is common. Let a good chain be one that keeps both budgets. At most D of the
U - D common boxes are followed by a differing one, and taking out of the ring each run
common-common-differing-differing takes as many differing as common boxes with it, so a
pair shares at least (2 s - 1) U good chains. Of a good chain's next two boxes the first
common one is, in either text, one or two places after the first two elements, as at most
one box lies between. So each text has for each place two chains of three elements, with
the next element and the one after it, and a pair has one in common for each good chain.
A text of n elements may therefore leave out its ceil((2 s - 1) n) - need most frequent
chains, and a pair still has `need` in common, `need` being the smaller of the texts' own.
No cap is set: the filter is exact.

1. Texts equal but for spaces, marks and case are one class, so copies are never compared.
2. Chains go to hash buckets as packed arrays, each with its class's place in a block of
   classes, and come back to the block counted; those that only one class has don't.
3. Classes keep their rarest chains; classes that share enough good ones are candidates.
4. Chains of `hot` classes or more (a disclaimer's, a template's) generate no candidates. Most
   classes leave them out anyway, as they may leave out their most frequent chains. Classes
   whose share of hot chains is greater are heavy; a pair with a class that is not heavy
   is found by other chains. Pairs of two heavy classes are found by single elements, chains
   of one: of n elements a class keeps the n - s n + 1 rarest, so that a pair shares one. Texts
   that are boilerplate for the greater part keep some hot elements even so; their lists are
   compared in blocks of that many by as many classes.
5. The full Hamming check compares the word runs of the candidates.

Buckets are as many as keep each near a fixed number of chains, whatever the input's size. What
so many classes have that a bucket would grow with the input is known beforehand from a
sample of classes: it counts as most frequent of all and is sent to no bucket. The order of
chains only has to be the same for all classes, so no sample changes the result.

Defined cases: null and empty texts and those with fewer than `min_words` words take no
part; repeated rows of one id count once; an id with several texts takes part with each;
tables without rows give none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.words import chains, mix, shingles, words
from scriptorium.session import cut
from scriptorium.tables import spread

#: Pairs that a bucket lists before it counts and passes them on.
PAIR_ROWS = 2_000_000
#: Classes, of eight bytes each, that may be broadcast.
FEW = 1_000_000
_CHAINS_A_TEXT = 320
_LOW = np.uint64(0xFFFFFFFF)


def text_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, cls): texts with the same words share a class."""
    text = F.col(text_col).cast("string")
    bare = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(bare).alias("cls")).where("id is not null and text is not null")


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _split(by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each part number that occurs in an array, in their order."""
    order = np.argsort(by, kind="stable")
    starts = np.flatnonzero(np.r_[True, by[order][1:] != by[order][:-1]]) if len(by) else []
    for start, end in zip(starts, [*starts[1:], len(by)]):
        yield int(by[order[start]]), order[start:end]


def _joined(rows: pd.DataFrame, **kinds: type) -> list[np.ndarray]:
    """The packed arrays of columns, each as one."""
    return [np.frombuffer(b"".join(rows[name]), kind) for name, kind in kinds.items()]


_MANY = 8192  # classes whose places in a block fit 16 bits


@dataclass(frozen=True)
class Limits:
    """Sizes that steer the work and change no result.

    bucket: chains that one bucket should hold, as a task sorts one in memory at a time; hot:
    classes with which a chain generates no candidates any more; sample: classes above which
    frequent chains are looked for in a sample of as many; frequent: sampled classes that
    make a chain frequent.
    """

    bucket: int = 1_000_000
    hot: int = 1000
    sample: int = 200_000
    frequent: int = 500


@dataclass(frozen=True)
class Filter:
    """What is compared: chains, or single elements; `frequent` are the sorted hashes that go to no bucket."""

    similarity: float
    size: int
    min_words: int
    need: float
    parts: int
    limits: Limits
    in_chains: bool = True
    frequent: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))

    def shared(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For texts of so many elements: how many chains a partner shares, and how many of these are to be among the kept."""
        n = sizes.astype(np.float64)
        if not self.in_chains:
            common = np.ceil(self.similarity * n - 1e-9)
            return common.astype(np.int64), np.ones(len(n), np.int64)
        common = np.ceil((2 * self.similarity - 1) * n - 1e-9)
        return common.astype(np.int64), np.clip(np.floor(self.need * n), 1, np.maximum(common, 1)).astype(np.int64)


def _rings(batches: Iterator[pd.DataFrame], rule: Filter) -> Iterator[tuple]:
    """The classes of each batch, their numbers of elements, the numbers of their chains, and these."""
    for batch in batches:
        classes, sizes, out = [], [], []
        batch = batch.drop_duplicates("cls")
        for cls, text in zip(batch["cls"], batch["text"]):
            found = words(text)
            if len(found) >= rule.min_words:
                ring = shingles(found, rule.size)
                if len(ring):
                    classes.append(cls)
                    sizes.append(len(ring))
                    out.append(chains(ring) if rule.in_chains else ring)
        if out:
            yield np.array(classes, np.int64), np.array(sizes, np.uint32), np.array([len(x) for x in out]), np.concatenate(out)


def _steps(places: np.ndarray) -> bytes:
    """Ascending places, as the steps between them, in a byte each where these are small."""
    steps = np.diff(places, prepend=0)
    return steps.astype(np.uint8 if steps.max(initial=0) < 256 else np.uint16).tobytes()


def _places(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8 if len(packed) == n else np.uint16), dtype=np.int64)


def _chains(batches: Iterator[pd.DataFrame], rule: Filter) -> Iterator[pd.DataFrame]:
    """Blocks of classes to packed chains by bucket: the lower 32 bits of each, and the class's place in its block.

    The classes themselves go with part -1, once a block.
    """
    names = ["part", "block", "who", "chain", "cls", "size", "common"]
    for classes, sizes, lengths, found in _rings(_slices(batches), rule):
        block = xxhash.xxh64_intdigest(classes.tobytes()) >> 1
        place = np.repeat(np.arange(len(classes)), lengths)
        common = np.zeros(len(classes), np.uint32)
        if len(rule.frequent):
            often = rule.frequent[np.minimum(np.searchsorted(rule.frequent, found), len(rule.frequent) - 1)] == found
            common = np.bincount(place[often], minlength=len(classes)).astype(np.uint32)
            place, found = place[~often], found[~often]
        bucket = ((found >> np.uint64(32)) % np.uint64(rule.parts)).astype(np.int64)
        found = (found & _LOW).astype(np.uint32)
        out = [(-1, block, b"", b"", *_pack(classes, sizes, common))]
        out += [(b, block, _steps(place[at]), found[at].tobytes(), b"", b"", b"") for b, at in _split(bucket)]
        yield pd.DataFrame(out, columns=names)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), _MANY):
            yield batch.iloc[start : start + _MANY]


def _counted(key: tuple, packed: pd.DataFrame) -> pd.DataFrame:
    """A bucket's chains that occur more than once, with their counts, by block; the blocks' classes pass."""
    names = ["block", "part", "who", "chain", "n", "cls", "size", "common"]
    if key[0] < 0:
        return packed.assign(n=b"")[names]
    (found,) = _joined(packed, chain=np.uint32)
    _, at, counts = np.unique(found, return_inverse=True, return_counts=True)
    counts = np.minimum(counts, 65535).astype(np.uint16)[at]
    out, start = [], 0
    for block, who, chain in zip(packed["block"], packed["who"], packed["chain"]):
        chain = np.frombuffer(chain, np.uint32)
        n = counts[start : start + len(chain)]
        start += len(chain)
        k = n > 1
        out.append((block, key[0], _steps(_places(who, len(chain))[k]), *_pack(chain[k], n[k]), b"", b"", b""))
    return pd.DataFrame(out, columns=names)


def _rarest(packed: pd.DataFrame, rule: Filter) -> pd.DataFrame:
    """For each class of a block its rarest chains, by bucket again; hot ones make a class heavy, hot elements are dealt to blocks.

    Heavy classes go to parts beyond the buckets, without chains.
    """
    names = ["bucket", "cls", "size", "chain"]
    known = packed[packed["part"] < 0].iloc[:1]
    classes, sizes, common = _joined(known, cls=np.int64, size=np.uint32, common=np.uint32)
    packed = packed[packed["part"] >= 0].drop_duplicates("part")  # a block that came twice has the same chains twice
    found, counts = _joined(packed, chain=np.uint32, n=np.uint16)
    who = np.concatenate([np.empty(0, np.int64), *(_places(w, len(c) // 4) for w, c in zip(packed["who"], packed["chain"]))])
    bucket = np.repeat(packed["part"].to_numpy().astype(np.int64), [len(x) // 4 for x in packed["chain"]])
    order = np.lexsort((found, bucket, counts, who))
    who, found, counts, bucket = who[order], found[order], counts[order], bucket[order]
    own = np.bincount(who, minlength=len(classes))
    share, want = rule.shared(sizes)
    left = own + common.astype(np.int64) - (share - want)  # chains that no other class has are the rarest, frequent ones the last
    at = np.flatnonzero(np.arange(len(who)) - (np.cumsum(own) - own)[who] < left[who])
    who, found, counts, bucket = who[at], found[at], counts[at], bucket[at]
    is_heavy = left > own  # it would keep frequent ones
    most = rule.limits.hot
    hot = counts >= most
    if rule.in_chains:
        is_heavy[who[hot]] = True
        who, found, bucket = who[~hot], found[~hot], bucket[~hot]
    elif hot.any():
        blocks = np.where(hot, -(-counts.astype(np.int64) // most), 1)
        mine = (classes[who].view(np.uint64) >> np.uint64(7)) % blocks.astype(np.uint64)
        rows = np.repeat(np.arange(len(who)), blocks)
        other = (np.arange(len(rows)) - np.repeat(np.cumsum(blocks) - blocks, blocks)).astype(np.uint64)
        mine, hot = mine[rows], hot[rows]
        who, found, bucket = who[rows], found[rows], bucket[rows]
        pair = np.minimum(mine, other) << np.uint64(16) | np.maximum(mine, other)
        dealt = mix((bucket.astype(np.uint64) << np.uint64(32) | found) * np.uint64(0x9E3779B97F4A7C15) + pair)
        bucket = np.where(hot, ((dealt >> np.uint64(32)) % np.uint64(rule.parts)).astype(np.int64), bucket)
        found = np.where(hot, (dealt & _LOW).astype(np.uint32), found)
    small = sizes.astype(np.uint16 if sizes.max(initial=0) < 1 << 16 else np.uint32)
    out = [(b, *_pack(classes[who[i]], small[who[i]], found[i])) for b, i in _split(bucket)]
    heavy = classes[is_heavy]
    if len(heavy):
        out.append((rule.parts + int(heavy[0] % 64), heavy.tobytes(), b"", b""))
    return pd.DataFrame(out, columns=names)


_PAIRS = ["grp", "a", "b", "want", "shared"]


def _shared(key: tuple, packed: pd.DataFrame, rule: Filter) -> Iterator[pd.DataFrame]:
    """A bucket's pairs of classes with equal good chains and possible sizes, packed by group of the first."""
    if key[0] >= rule.parts:
        yield pd.DataFrame([(i % rule.parts, x, b"", b"", b"") for i, x in enumerate(packed["cls"])], columns=_PAIRS)
        return
    classes, found = _joined(packed, cls=np.int64, chain=np.uint32)
    sizes = np.concatenate([np.frombuffer(x, np.uint16 if 2 * len(x) == len(y) else np.uint32) for x, y in zip(packed["size"], packed["chain"])])
    order = np.lexsort((classes, found))
    classes, sizes, found = classes[order], sizes[order].astype(np.int64), found[order]
    first = np.r_[True, (found[1:] != found[:-1]) | (classes[1:] != classes[:-1])]  # copies in other blocks
    classes, sizes, found = classes[first], sizes[first], found[first]
    reach = np.searchsorted(found, found, side="right") - np.arange(len(found)) - 1  # later rows with the same chain
    wants = np.minimum(rule.shared(sizes)[1], 65535).astype(np.uint16)
    step, block, rows = 0, [], 0
    at = np.flatnonzero(reach > 0)
    while len(at):
        step += 1
        small, large = np.minimum(sizes[at], sizes[at + step]), np.maximum(sizes[at], sizes[at + step])
        fit = at[small >= rule.similarity * large - 1e-9]
        block.append((classes[fit], classes[fit + step], np.minimum(wants[fit], wants[fit + step])))
        rows += len(fit)
        at = at[reach[at] > step]
        if rows > PAIR_ROWS or not len(at):
            a, b, want = (np.concatenate(x) for x in zip(*block))
            block, rows = [], 0
            order = np.lexsort((b, a))
            a, b, want = a[order], b[order], want[order]
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else order
            shared = np.minimum(np.diff(np.r_[new, len(a)]), 65535).astype(np.uint16)
            a, b, want = a[new], b[new], want[new]
            group = (a.view(np.uint64) % np.uint64(rule.parts)).astype(np.int64)
            yield pd.DataFrame([(g, *_pack(a[i], b[i], want[i], shared[i])) for g, i in _split(group)], columns=_PAIRS)


def _enough(packed: pd.DataFrame) -> pd.DataFrame:
    """A group's pairs that share as many chains in all buckets as they need; heavy classes come as pairs without a second."""
    lone = packed["b"].map(len) == 0
    (heavy,) = _joined(packed[lone], a=np.int64)
    a, b, want, shared = _joined(packed[~lone], a=np.int64, b=np.int64, want=np.uint16, shared=np.uint16)
    order = np.lexsort((b, a))
    a, b, want, shared = a[order], b[order], want[order], shared[order].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else order
    ok = np.add.reduceat(shared, new) >= want[new] if len(a) else np.empty(0, bool)
    pairs = pd.DataFrame({"a": a[new][ok], "b": pd.array(b[new][ok], dtype="Int64")})
    return pd.concat([pairs, pd.DataFrame({"a": heavy, "b": pd.array([None] * len(heavy), dtype="Int64")})])


def _frequent(rows: DataFrame, total: int, rule: Filter) -> np.ndarray:
    """The hashes of chains that many classes have, from a sample of classes where there are more than it holds."""
    limits = rule.limits
    if total <= limits.sample:
        return np.empty(0, np.uint64)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for *_, found in _rings(batches, rule):
            values, n = np.unique(found, return_counts=True)
            yield pd.DataFrame({"chain": values.view(np.int64), "n": n})

    sampled = rows.where(F.pmod("cls", F.lit(-(-total // limits.sample))) == 0).select("cls", "text")
    often = sampled.mapInPandas(counts, "chain long, n long").groupBy("chain").agg(F.sum("n").alias("n")).where(F.col("n") >= limits.frequent)
    found = often.orderBy(F.desc("n"), "chain").limit(FEW).select("chain").collect()
    return np.sort(np.array([r.chain for r in found], np.int64).view(np.uint64))


def _candidates(rows: DataFrame, rule: Filter) -> DataFrame:
    """(a, b): pairs of classes that the filter leaves, and (a, null) heavy classes."""

    def dealt(batches):
        return _chains(batches, rule)

    def rarest(packed):
        return _rarest(packed, rule)

    def shared(key, packed):
        found = list(_shared(key, packed, rule))
        return pd.concat(found) if found else pd.DataFrame(columns=_PAIRS)

    table = "cls binary, size binary, common binary"
    packed = rows.select("cls", "text").mapInPandas(dealt, f"part int, block long, who binary, chain binary, {table}")
    several = packed.repartition(rule.parts, "part", F.when(F.col("part") < 0, F.col("block"))).groupBy("part", F.when(F.col("part") < 0, F.col("block")).alias("b"))
    several = several.applyInPandas(_counted, f"block long, part int, who binary, chain binary, n binary, {table}")
    rare = several.repartition(rule.parts, "block").groupBy("block").applyInPandas(rarest, "bucket int, cls binary, size binary, chain binary")
    pairs = rare.repartition(rule.parts, "bucket").groupBy("bucket").applyInPandas(shared, "grp int, a binary, b binary, want binary, shared binary")
    return cut(pairs.repartition(rule.parts, "grp").groupBy("grp").applyInPandas(_enough, "a long, b long"))


def candidate_classes(rows: DataFrame, total: int, similarity: float, size: int, min_words: int, need: float = 0.05, limits: Limits = Limits()) -> DataFrame:
    """(a, b), a < b: the pairs of classes that the filter leaves. `rows` has (cls, text), copies too.

    By chains among all classes; by elements among those that are heavy there; and once
    more, with no element left out as frequent, among those that are heavy even so.
    """
    if not 0.5 < similarity <= 1:
        raise ValueError("the similarity must be above 0.5 and at most 1")
    least = 2 * rows.sparkSession.sparkContext.defaultParallelism
    pairs = None
    for in_chains, sampled in ((True, True), (False, True), (False, False)):
        rule = Filter(similarity, size, min_words, need, max(least, math.ceil(total * _CHAINS_A_TEXT / limits.bucket)), limits, in_chains)
        found = _candidates(rows, replace(rule, frequent=_frequent(rows, total, rule)) if sampled else rule)
        some = found.where("b is not null")
        pairs = some if pairs is None else pairs.unionByName(some).distinct()
        heavy = found.where("b is null").select(F.col("a").alias("cls")).distinct()
        total = heavy.count()
        if not total:
            break
        rows = rows.join(heavy, "cls", "left_semi")
    return pairs


def _full_check(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """(a, b) of the candidate pairs whose word runs have at least the similarity. `texts` has one row per class."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"cls": batch["cls"], "runs": [shingles(words(t), size).tobytes() for t in batch["text"]]})

    runs = texts.select("cls", "text").mapInPandas(sets, "cls long, runs binary")
    left, right = runs.select(F.col("cls").alias("a"), F.col("runs").alias("x")), runs.select(F.col("cls").alias("b"), F.col("runs").alias("y"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            alike = []
            for x, y in zip(batch["x"], batch["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield batch.loc[np.array(alike, bool), ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(compare, "a long, b long")


@dataclass
class Links:
    """What a run found: members (id, cls), links (a, b) between classes, fit (cls) of enough words with copies."""

    members: DataFrame
    links: DataFrame
    fit: DataFrame


def find_links(df: DataFrame, id_col: str, text_col: str, similarity: float, size: int, min_words: int, limits: Limits = Limits()) -> Links:
    """All links between classes of different texts, and the classes that several ids share."""
    rows = text_classes(spread(df.select(id_col, text_col)), id_col, text_col)
    members = cut(rows.select("id", "cls").distinct())
    pairs = cut(candidate_classes(rows, members.count(), similarity, size, min_words, limits=limits))
    several = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
    used = pairs.select(F.explode(F.array("a", "b")).alias("cls")).unionByName(several).distinct()
    if used.limit(FEW + 1).count() <= FEW:  # then the other texts need not be shuffled
        used = F.broadcast(used)
    texts = cut(rows.join(used, "cls", "left_semi").groupBy("cls").agg(F.min("text").alias("text")))

    def enough(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[[len(words(t)) >= max(min_words, size) for t in batch["text"]], ["cls"]]

    fit = texts.mapInPandas(enough, "cls long").join(several, "cls", "left_semi")
    return Links(members, cut(_full_check(pairs, texts, similarity, size)), fit)


def near_pairs(df: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, size: int = 5, min_words: int = 1, limits: Limits = Limits()) -> DataFrame:
    """(id_a, id_b), id_a < id_b: ids whose texts have at least the similarity, copies expanded."""
    found = find_links(df, id_col, text_col, similarity, size, min_words, limits)
    members = found.members
    mine, other = members.select(F.col("id").alias("x"), F.col("cls").alias("a")), members.select(F.col("id").alias("y"), F.col("cls").alias("b"))
    between = found.links.join(mine, "a").join(other, "b").select("x", "y")
    own = members.join(found.fit, "cls", "left_semi")
    within = own.select(F.col("id").alias("x"), "cls").join(own.select(F.col("id").alias("y"), "cls"), "cls").where("x < y").select("x", "y")
    both = between.unionByName(within).where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_groups(df: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, size: int = 5, min_words: int = 1, limits: Limits = Limits()) -> DataFrame:
    """(id, cls, group, links): every id with its class of copies, its group of near-duplicates and its class's links.

    A group is a connected component of links between classes; `group` is its smallest
    class. Ids with null texts, which have no class, are left out.
    """
    found = find_links(df, id_col, text_col, similarity, size, min_words, limits)
    links = found.links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    out = found.members.join(components(found.links), "cls", "left").join(links, "cls", "left")
    return out.select("id", "cls", F.coalesce("group", "cls").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def components(links: DataFrame) -> DataFrame:
    """(cls, group) of the connected components of links (a, b), by alternating large and small stars.

    Each round costs two shuffles of the links, and the rounds grow with the logarithm of
    the longest path. Hubs are pre-aggregated by min; no star is ever gathered in a task.
    """
    edges = links.select("a", "b").where("a <> b").distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        if small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty():
            break
        edges = small
    tops = edges.select(F.col("b").alias("cls"), F.col("b").alias("group"))
    return edges.select(F.col("a").alias("cls"), F.col("b").alias("group")).unionByName(tops).groupBy("cls").agg(F.min("group").alias("group"))
