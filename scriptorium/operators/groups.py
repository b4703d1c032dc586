"""Groups of records: vectors' centres and members, clustering runs, coverage by analysed samples.

Vectors are arrays of numbers keyed by id; rows with null vectors are left out. Group and
rank orders break ties by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import cut

#: Rows of a block of vectors; two blocks and the distances between their rows are held by a task.
DENSITY_BLOCK = 1024
#: Edges of spanning trees.
_EDGE = np.dtype([("w", "f8"), ("a", "i8"), ("b", "i8")])


def central(df: DataFrame, group: str, id_col: str, vector: str, n: int = 3) -> DataFrame:
    """(group, rank, id, distance): the n members nearest to their group's mean vector.

    Means are partial sums by group and dimension, so no group is gathered.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(id_col).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    means = rows.select("g", F.posexplode("v").alias("d", "x")).groupBy("g", "d").agg(F.avg("x").alias("m"))
    means = means.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("m"))
    apart = F.sqrt(F.aggregate(F.zip_with("v", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    far = rows.join(means, "g").select("g", "i", F.round(apart, 6).alias("distance"))
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("distance", "i")))
    return ranked.where(F.col("rank") <= n).select(F.col("g").alias(group), "rank", F.col("i").alias(id_col), "distance")


def _features(df: DataFrame, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).withColumn("_f", array_to_vector(F.col(vector).cast("array<double>")))


def best_k(df: DataFrame, vector: str, most: int = 10, seed: int = 42) -> int:
    """The number of groups at the sharpest bend of the inertia over k, between 3 and 7 where the rows allow."""
    rows = _features(df, vector).select("_f").persist()
    total = rows.count()
    if total < 2:
        return 2
    costs = [KMeans(k=k, seed=seed, featuresCol="_f").fit(rows).summary.trainingCost for k in range(2, min(most, total - 1) + 1)]
    rows.unpersist()
    if len(costs) < 3:
        return min(3, total)
    bends = np.diff(np.diff(costs))
    return int(max(3, min(7, int(np.argmax(bends)) + 3)))


def kmeans(df: DataFrame, id_col: str, vector: str, k: int | None = None, seed: int = 42, tries: int = 3) -> DataFrame:
    """(id, cluster, distance): the best of several seeded runs by cost."""
    rows = _features(df, vector)
    k = k or best_k(df, vector)
    fits = [KMeans(k=k, seed=seed + i, featuresCol="_f", predictionCol="cluster").fit(rows) for i in range(tries)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    centres = [c.tolist() for c in best.clusterCenters()]
    centre = F.get(F.array(*(F.array(*map(F.lit, c)) for c in centres)), F.col("cluster"))
    apart = F.sqrt(F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    return best.transform(rows).select(F.col(id_col).alias(id_col), "cluster", apart.alias("distance"))


def silhouette(df: DataFrame, vector: str, label: str) -> float:
    return ClusteringEvaluator(featuresCol="_f", predictionCol=label).evaluate(_features(df, vector).withColumn(label, F.col(label).cast("int")))


# Density clustering.


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances, rounded to float32 so that a pair has the same in every block it is in."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0)).astype(np.float32).astype(float)


def _spanning(d: np.ndarray, core: np.ndarray) -> np.ndarray:
    """The edges of the least spanning tree of mutual reachability, as _EDGE, from distances and core distances."""
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    left = np.ones(len(d), bool)
    left[0] = False
    near, to = reach[0].copy(), np.zeros(len(d), int)
    near[0] = np.inf
    edges = np.zeros(len(d) - 1, _EDGE)
    for k in range(len(edges)):
        j = int(np.argmin(near))
        edges[k] = (near[j], to[j], j)
        left[j], near[j] = False, np.inf
        closer = left & (reach[j] < near)
        near[closer], to[closer] = reach[j][closer], j
    return edges


def _forest(edges: np.ndarray) -> np.ndarray:
    """The least spanning forest of edges, by length."""
    edges = edges[np.lexsort((edges["b"], edges["a"], edges["w"]))]
    ends = np.unique(np.concatenate([edges["a"], edges["b"]]), return_inverse=True)[1]
    parent = list(range(len(ends)))
    kept = np.zeros(len(edges), bool)
    for k, (a, b) in enumerate(zip(ends[: len(edges)].tolist(), ends[len(edges) :].tolist())):
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[a] = b
            kept[k] = True
    return edges[kept]


def _tree(x: np.ndarray, samples: int) -> list[tuple[float, int, int]]:
    """The edges of the least spanning tree of mutual reachability, by length."""
    d = _apart(x, x)
    return sorted(_spanning(d, np.sort(d, 1)[:, min(samples, len(x) - 1)]).tolist())


def density_labels(x: np.ndarray, least: int = 5, samples: int = 2) -> np.ndarray:
    """Labels of dense groups of `least` rows or more, -1 outside them: the hierarchy's most stable groups."""
    n = len(x)
    return _labels(n, _tree(x, samples), least) if n >= max(least, 2) else np.full(n, -1)


def _labels(n: int, edges: list[tuple[float, int, int]], least: int) -> np.ndarray:
    """density_labels from the spanning tree's edges, by length."""
    size, parent, kids, height = [1] * n, list(range(n)), [None] * n, [0.0] * n

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for w, a, b in edges:
        a, b = find(a), find(b)
        node = len(size)
        size.append(size[a] + size[b])
        parent.append(node)
        kids.append((a, b))
        height.append(w)
        parent[a] = parent[b] = node

    def rows_of(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            k = todo.pop()
            if kids[k]:
                todo += kids[k]
            else:
                out.append(k)
        return out

    labels = np.full(n, -1)
    top = len(size) - 1
    # Each entry: node where a group begins, its stability so far, and the groups below it.
    groups: list[dict] = [{"node": top, "birth": 0.0, "stability": 0.0, "below": []}]
    todo = [(top, 0)]
    while todo:
        node, g = todo.pop()
        if not kids[node]:
            continue
        density = 1 / height[node] if height[node] > 0 else 1e12
        under, same = [], list(kids[node])
        while same:  # what meets at one length meets at once, in whatever order its edges came
            k = same.pop()
            if kids[k] and height[k] == height[node]:
                same += kids[k]
            else:
                under.append(k)
        big = [k for k in under if size[k] >= least]
        if len(big) > 1:
            groups[g]["stability"] += (density - groups[g]["birth"]) * size[node]
            for k in big:
                groups.append({"node": k, "birth": density, "stability": 0.0, "below": []})
                groups[g]["below"].append(len(groups) - 1)
                todo.append((k, len(groups) - 1))
        else:
            for k in under:
                if size[k] < least:
                    groups[g]["stability"] += (density - groups[g]["birth"]) * size[k]
                else:
                    todo.append((k, g))
    chosen = [False] * len(groups)
    score = [0.0] * len(groups)
    for g in range(len(groups) - 1, -1, -1):
        below = sum(score[k] for k in groups[g]["below"])
        if g and (not groups[g]["below"] or groups[g]["stability"] > below):
            chosen[g], score[g] = True, groups[g]["stability"]
        else:
            score[g] = below
    todo2, label = [0], 0
    while todo2:
        g = todo2.pop()
        if chosen[g]:
            labels[rows_of(groups[g]["node"])] = label
            label += 1
        else:
            todo2 += groups[g]["below"]
    return labels


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """(b, i, v): rows dealt by hash to blocks of about `block`, each block's ids and its vectors' bytes in one row."""
    parts = max(1, math.ceil(rows.count() / block))

    def pack(batch: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(batch["v"].to_numpy())
        order = np.lexsort((*v.T[::-1], batch["i"].to_numpy())) if batch["i"].notna().all() else np.arange(len(v))
        return pd.DataFrame({"b": [batch["b"].iloc[0]], "i": [batch["i"].to_numpy()[order]], "v": [v[order].tobytes()]})

    dealt = rows.withColumn("b", F.pmod(F.xxhash64("i", "v"), F.lit(parts)).cast("int"))
    return cut(dealt.groupBy("b").applyInPandas(pack, f"b int, i array<{rows.schema['i'].dataType.simpleString()}>, v binary"))


def _density_tree(blocks: DataFrame, start: dict[int, int], dims: int, samples: int) -> list[tuple[float, int, int]]:
    """The spanning tree of mutual reachability over the rows of all blocks, block b's from start[b] on.

    Any two rows are together in a pair of blocks, whose own least tree joins them over no
    longer an edge; so the least tree of all pairs' trees is that of all rows.
    """
    spark = blocks.sparkSession
    tasks = 2 * max(1, spark.sparkContext.defaultParallelism)
    pairs = blocks.select("b", "v").crossJoin(blocks.select(F.col("b").alias("c"), F.col("v").alias("w")))
    vectors = lambda raw: np.frombuffer(raw).reshape(-1, dims)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for b, v, c, w in batch.itertuples(index=False):
                d = _apart(vectors(v), vectors(w))
                for at, part in ((b, d), (c, d.T)) if b != c else ((b, d),):
                    part = np.concatenate([held[at], part], 1) if at in held else part
                    held[at] = np.partition(part, samples, 1)[:, : samples + 1] if part.shape[1] > samples else part
        yield pd.DataFrame([(b, d.shape[1], d.tobytes()) for b, d in held.items()], columns=["b", "n", "d"])

    def core(batch: pd.DataFrame) -> pd.DataFrame:
        d = np.sort(np.concatenate([np.frombuffer(d).reshape(-1, n) for n, d in zip(batch["n"], batch["d"])], 1), 1)
        return pd.DataFrame({"b": [batch["b"].iloc[0]], "d": [d[:, min(samples, d.shape[1] - 1)].tobytes()]})

    found = pairs.where("b <= c").coalesce(tasks).mapInPandas(nearest, "b int, n int, d binary").groupBy("b").applyInPandas(core, "b int, d binary")
    sent = spark.sparkContext.broadcast({r.b: np.frombuffer(r.d) for r in found.collect()})

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, most = np.zeros(0, _EDGE), 100_000
        for batch in batches:
            for b, v, c, w in batch.itertuples(index=False):
                own = [b] if b == c else [b, c]
                x = np.concatenate([vectors(v), vectors(w)][: len(own)])
                at = np.concatenate([np.arange(len(sent.value[k])) + start[k] for k in own])
                edges = _spanning(_apart(x, x), np.concatenate([sent.value[k] for k in own]))
                edges["a"], edges["b"] = at[edges["a"]], at[edges["b"]]
                held = np.concatenate([held, edges])
                if len(held) > most:
                    held = _forest(held)
                    most = max(most, 2 * len(held))
        if len(held):
            yield pd.DataFrame({"t": [int(held["a"][0] % 1009)], "e": [_forest(held).tobytes()]})

    def join(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"t": [batch["t"].iloc[0]], "e": [_forest(np.concatenate([np.frombuffer(e, _EDGE) for e in batch["e"]])).tobytes()]})

    made = cut(pairs.where("b < c" if len(start) > 1 else "b = c").coalesce(tasks).mapInPandas(trees, "t int, e binary"))
    for groups in (8, 1):
        made = made.withColumn("t", F.pmod(F.col("t"), F.lit(groups))).groupBy("t").applyInPandas(join, "t int, e binary")
    return np.frombuffer(made.first().e, _EDGE).tolist()


def density(df: DataFrame, id_col: str, vector: str, least: int = 5, sample: int | None = None, samples: int = 2) -> DataFrame:
    """(id, cluster): dense groups of any form, -1 for rows outside them.

    The groups are fitted on all rows: core distances and the spanning tree come from the
    pairs of blocks of DENSITY_BLOCK rows, so time grows with the square of the rows; the
    driver holds the tree, an edge a row, and the labels. Only where `sample` is given are
    they fitted on so many rows with the lowest hashes; then each row gets the group of its
    nearest sampled row if it is not farther than twice that group's mean nearest distance.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    if sample is not None:
        return _density_sampled(rows, id_col, least, sample, samples)
    blocks = _blocks(rows, DENSITY_BLOCK)
    sizes = sorted(tuple(r) for r in blocks.select("b", F.size("i"), (F.length("v") / 8 / F.size("i")).cast("int")).collect())
    start, n = {}, 0
    for b, size, _ in sizes:
        start[b], n = n, n + size
    labels = _labels(n, _density_tree(blocks, start, sizes[0][2], samples), least) if n >= max(least, 2) else np.full(n, -1)
    sent = df.sparkSession.sparkContext.broadcast(labels.astype("int32"))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, ids in batch.itertuples(index=False):
                yield pd.DataFrame({id_col: ids, "cluster": sent.value[start[b] : start[b] + len(ids)]})

    return blocks.select("b", "i").mapInPandas(assign, f"{id_col} {rows.schema['i'].dataType.simpleString()}, cluster int")


def _density_sampled(rows: DataFrame, id_col: str, least: int, sample: int, samples: int) -> DataFrame:
    picked = rows.orderBy(F.xxhash64("i"), "i").limit(sample).collect()
    if not picked:
        return rows.select(F.col("i").alias(id_col), F.lit(-1).alias("cluster"))
    x = np.array([r.v for r in picked])
    labels = density_labels(x, least, samples)
    gap = np.full(max(1, labels.max() + 1), 0.0)
    for g in range(labels.max() + 1):
        own = x[labels == g]
        d = np.sqrt(np.maximum((own**2).sum(1)[:, None] + (own**2).sum(1)[None] - 2 * own @ own.T, 0))
        np.fill_diagonal(d, np.inf)
        gap[g] = 2 * d.min(1).mean()
    sent = rows.sparkSession.sparkContext.broadcast((x, labels, gap))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, labels, gap = sent.value
        for batch in batches:
            if not len(batch):
                continue
            y = np.stack(batch["v"].to_numpy())
            d = np.sqrt(np.maximum((y**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * y @ x.T, 0))
            at = d.argmin(1)
            near = d[np.arange(len(y)), at]
            g = labels[at]
            ok = (near < 1e-9) | ((g >= 0) & (near <= gap[np.maximum(g, 0)]))
            yield pd.DataFrame({id_col: batch["i"], "cluster": np.where(ok, g, -1).astype("int32")})

    return rows.mapInPandas(assign, f"{id_col} {rows.schema['i'].dataType.simpleString()}, cluster int")


# Clustering runs with their members.


def members(runs: DataFrame) -> DataFrame:
    """(run_id, cluster, is_noise, position, id) of a table of runs; null lists have no member."""
    one = runs.select("run_id", F.posexplode("clusters").alias("place", "c"))
    return one.select("run_id", F.col("c.id").alias("cluster"), F.coalesce("c.is_noise", F.lit(False)).alias("is_noise"), F.posexplode("c.sample_ids").alias("position", "id"))


def remaining(runs: DataFrame, analysed: DataFrame, id_col: str) -> DataFrame:
    """(run_id, cluster, position, id): members of groups, noise aside, that no analysed sample has; order kept."""
    done = analysed.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    return members(runs).where(~F.col("is_noise")).join(done, "id", "left_anti").select("run_id", "cluster", "position", "id")


def coverage(runs: DataFrame, analysed: DataFrame, id_col: str, least: float = 0.8) -> DataFrame:
    """Per group the members, the analysed among them, the share, and how many are required."""
    done = analysed.select(F.col(id_col).alias("id"), F.lit(1).alias("hit")).where("id is not null").distinct()
    rows = members(runs).where(~F.col("is_noise")).join(done, "id", "left")
    out = rows.groupBy("run_id", "cluster").agg(F.count("*").alias("n"), F.count("hit").alias("analysed"))
    return out.select(
        "run_id", "cluster", "n", "analysed", F.round(F.col("analysed") / F.col("n"), 6).alias("coverage"), F.floor(F.col("n") * least + 0.999).alias("required"),
        (F.col("analysed") >= F.floor(F.col("n") * least + 0.999)).alias("complete"),
    )


def health(runs: DataFrame, silhouettes: DataFrame | None = None) -> DataFrame:
    """A run's number of groups, share of noise and warnings; sizes are the lists' own, not the recorded ones.

    With (run_id, silhouette), runs of more than one group below 0.15 are warned of too.
    """
    sizes = runs.select("run_id", F.explode("clusters").alias("c")).select("run_id", F.coalesce("c.is_noise", F.lit(False)).alias("noise"), F.greatest(F.size("c.sample_ids"), F.lit(0)).alias("n"))
    rows = sizes.groupBy("run_id").agg(F.count_if(~F.col("noise")).alias("groups"), F.coalesce(F.sum(F.when(F.col("noise"), F.col("n"))), F.lit(0)).alias("noise"), F.sum("n").alias("total"))
    share = F.coalesce(F.col("noise") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    warnings = F.array_compact(F.array(
        F.when(F.col("groups") < 3, F.lit("few_groups")), F.when(F.col("groups") > 10, F.lit("many_groups")),
        F.when(share > 0.3, F.lit("high_noise")).when(share > 0.1, F.lit("moderate_noise")), F.when((F.col("silhouette") < 0.15) & (F.col("groups") > 1), F.lit("low_silhouette")),
    ))
    rows = rows.withColumn("silhouette", F.lit(None).cast("double")) if silhouettes is None else rows.join(silhouettes, "run_id", "left")
    return rows.select("run_id", "groups", "noise", "total", F.round(share, 6).alias("noise_share"), F.array_join(warnings, ",").alias("warnings"))


def chunks(runs: DataFrame, most: int = 150) -> DataFrame:
    """(run_id, cluster, chunk, n): groups cut into chunks of at most so many members, in order."""
    chunk = F.concat(F.col("cluster").cast("string"), F.lit("_"), F.floor(F.col("position") / most).cast("string"))
    return members(runs).where(~F.col("is_noise")).groupBy("run_id", "cluster", chunk.alias("chunk")).agg(F.count("*").alias("n"))


def next_group(runs: DataFrame, analysed: DataFrame, id_col: str) -> DataFrame:
    """(run_id, cluster, left): of each run the largest group with members left to analyse, ties by number."""
    left = remaining(runs, analysed, id_col).groupBy("run_id", "cluster").agg(F.count("*").alias("left"))
    whole = members(runs).groupBy("run_id", "cluster").agg(F.count("*").alias("n"))
    ranked = left.join(whole, ["run_id", "cluster"]).withColumn("k", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n"), "cluster")))
    return ranked.where("k = 1").select("run_id", "cluster", "left")


def summary(runs: DataFrame, records: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(run_id, cluster, dimension, value, n): how the members' labels are spread; empty labels are skipped."""
    known = records.select(F.col(id_col).alias("id"), *columns).dropDuplicates(["id"])
    rows = members(runs).join(known, "id").select("run_id", "cluster", *columns)
    long = rows.unpivot(["run_id", "cluster"], columns, "dimension", "value").where("value is not null and value <> ''")
    return long.groupBy("run_id", "cluster", "dimension", "value").agg(F.count("*").alias("n"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def alike(df: DataFrame, id_col: str, text_col: str, least: float = 0.3) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: texts alike by the cosine of their word counts.

    Pairs come from a join on words of four letters or more, so texts without a word in
    common are never paired. Meant for tables of descriptions, which are few.
    """
    words = df.select(F.col(id_col).alias("i"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w")).where("length(w) >= 4")
    counts = words.groupBy("i", "w").agg(F.count("*").alias("n"))
    norms = counts.groupBy("i").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("z"))
    a, b = counts.select(F.col("i").alias("id_a"), "w", F.col("n").alias("na")), counts.select(F.col("i").alias("id_b"), "w", F.col("n").alias("nb"))
    dots = a.join(b, "w").where("id_a < id_b").groupBy("id_a", "id_b").agg(F.sum(F.col("na") * F.col("nb")).alias("d"))
    za, zb = norms.select(F.col("i").alias("id_a"), F.col("z").alias("za")), norms.select(F.col("i").alias("id_b"), F.col("z").alias("zb"))
    out = dots.join(za, "id_a").join(zb, "id_b").select("id_a", "id_b", F.round(F.col("d") / (F.col("za") * F.col("zb")), 6).alias("cosine"))
    return out.where(F.col("cosine") >= least)


def run(df: DataFrame, id_col: str, vector: str, algorithm: str = "auto", k: int | None = None, least: int = 5) -> DataFrame:
    """(id, cluster): by density from 20 rows on, else by k-means, unless one is asked for."""
    if algorithm not in ("auto", "density", "kmeans"):
        raise ValueError(f"unknown algorithm {algorithm}")
    if algorithm == "auto":
        algorithm = "density" if df.where(F.col(vector).isNotNull()).limit(20).count() == 20 else "kmeans"
    return density(df, id_col, vector, least) if algorithm == "density" else kmeans(df, id_col, vector, k).select(id_col, "cluster")


def overview(assigned: DataFrame, noise: int = -1) -> DataFrame:
    """(cluster, size, is_noise, place): groups, the largest first and what is outside last."""
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("size")).withColumn("is_noise", F.col("cluster") == noise)
    return sizes.withColumn("place", F.row_number().over(Window.orderBy("is_noise", F.desc("size"), "cluster")))  # a row a group


def alike_vectors(df: DataFrame, id_col: str, vector: str, least: float = 0.85) -> DataFrame:
    """(id_a, id_b, cosine), id_a < id_b: rows whose vectors are alike, compared in blocks; all-zero vectors are like none."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.withColumn("z", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("z > 0")
    first = rows.first()
    kind = rows.schema["i"].dataType.simpleString()
    if first is None:
        return rows.select(F.col("i").alias("id_a"), F.col("i").alias("id_b"), F.col("z").alias("cosine"))
    dims = len(first.v)
    blocks = _blocks(rows.select("i", F.transform("v", lambda x: x / F.col("z")).alias("v")), DENSITY_BLOCK)
    pairs = blocks.crossJoin(blocks.select(F.col("b").alias("c"), F.col("i").alias("j"), F.col("v").alias("w"))).where("b <= c")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, i, v, c, j, w in batch[["b", "i", "v", "c", "j", "w"]].itertuples(index=False):
                near = np.frombuffer(v).reshape(-1, dims) @ np.frombuffer(w).reshape(-1, dims).T
                x, y = np.nonzero(np.triu(near >= least - 1e-12, 1) if b == c else near >= least - 1e-12)
                p, q = np.asarray(i)[x], np.asarray(j)[y]
                yield pd.DataFrame({"id_a": np.minimum(p, q) if p.dtype != object else [min(u) for u in zip(p, q)], "id_b": np.maximum(p, q) if p.dtype != object else [max(u) for u in zip(p, q)], "cosine": near[x, y]})

    return pairs.mapInPandas(compare, f"id_a {kind}, id_b {kind}, cosine double").withColumn("cosine", F.round("cosine", 6))
