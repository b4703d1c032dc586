"""Mixtures of sources by Poisson replication.

A row of a source is used as often as a Poisson variable of the source's rate, inverted
from a uniform hash of the row's id, the mixture and a seed, and cut at `max_repeats`. The
rate is the one at which the source's size meets its target: size grows with the rate, as
a row's uniform value stays, so the rate is found from how the source's size is spread
over these values. That spread is summed to BINS bins by source and mixture, which is all
that reaches the driver, whatever the number of rows. Copies get a hash of their own as
place in the mixture, by which they are sorted over all partitions.

A source too small for its target even at max_repeats is used max_repeats times; the
others keep their targets, and the shares reached, of the mixture as it came out, tell.

Defined cases: rows with a null source belong to no source but count in the size of the
whole; null and empty texts have size 0 and are used like others; sources match in lower
case, trimmed, - read as _; a source without rows is reported with 0; a target that stands
twice for one mixture and source is an error; rows of one id are used alike.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of the spread of a source's size over the uniform values.
BINS = 4096
#: Targets (mixture and source) beyond this are refused: their spread would not fit the driver.
MAX_TARGETS = 500


def source_key(column):
    """A source's name for matching."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(column, r"[\s ]+", " "), "-", "_")))


def uniform(*columns):
    """A number of [0, 1) from a hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def thresholds(rate: float, most: int) -> list[float]:
    """A row whose uniform value reaches n of these numbers is used n times."""
    out, term, total = [], math.exp(-rate), 0.0
    for k in range(most):
        total += term
        out.append(min(total, 1.0))
        term *= rate / (k + 1)
    return out


def solve(spread: list[float], target: float, most: int) -> float:
    """The rate at which rows whose size lies as `spread` over the bins give the target size."""
    bins = len(spread)
    above = [0.0] * (bins + 1)
    for i in range(bins - 1, -1, -1):
        above[i] = above[i + 1] + spread[i]
    if target <= 0 or above[0] <= 0:
        return 0.0
    if target >= most * above[0]:
        return math.inf

    def size(rate: float) -> float:
        out = 0.0
        for t in thresholds(rate, most):
            x = min(t * bins, float(bins))
            i = min(int(x), bins - 1)
            out += above[i + 1] + spread[i] * (i + 1 - x)
        return out

    low, high = 0.0, 1.0
    while size(high) < target and high < 600:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if size(middle) < target else (low, middle)
    return high


def plan_rates(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> list[dict]:
    """Targets with their thresholds. sizes: (id, source, size); targets: as mix_target."""
    spark = sizes.sparkSession
    rows = targets.select(
        "mix_id", source_key(F.col("source")).alias("source"), "target_share", "max_repeats", "corpus_share"
    ).orderBy("mix_id", "source").collect()  # what the mixtures are to be, a row a target
    if len({(r.mix_id, r.source) for r in rows}) < len(rows):
        raise ValueError("a source stands twice in a mixture")
    if not rows:
        return []
    spreads: dict = {(r.mix_id, r.source): [0.0] * BINS for r in rows}
    for start in range(0, len(rows), MAX_TARGETS):  # at most MAX_TARGETS * BINS rows at a time
        some = [(r.mix_id, r.source) for r in rows[start : start + MAX_TARGETS]]
        keys = F.broadcast(spark.createDataFrame(some, "mix_id int, source string"))
        binned = sizes.join(keys, "source").select(
            "mix_id", "source", F.least(F.floor(uniform(F.lit(seed), "id", "mix_id") * BINS).cast("int"), F.lit(BINS - 1)).alias("bin"), "size"
        )
        for r in binned.groupBy("mix_id", "source", "bin").agg(F.sum("size").alias("size")).collect():
            spreads[r.mix_id, r.source][r.bin] = float(r["size"])
    total = float(sizes.agg(F.sum("size")).first()[0] or 0)
    out = []
    for r in rows:
        most = max(0, r.max_repeats or 0)
        rate = solve(spreads[r.mix_id, r.source], (r.target_share or 0.0) * (r.corpus_share or 0.0) * total, most)
        out.append(r.asDict() | {"thresholds": [0.0] * most if math.isinf(rate) else thresholds(rate, most), "rate": rate})
    return out


def mixtures(sizes: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(mix_id, id, source, copy_no, size, place): each use of a row, sorted by mixture and place."""
    rates = plan_rates(sizes, targets, seed)
    spark = sizes.sparkSession
    plan = spark.createDataFrame([(r["mix_id"], r["source"], r["thresholds"]) for r in rates], "mix_id int, source string, steps array<double>")
    used = sizes.join(F.broadcast(plan), "source").withColumn("u", uniform(F.lit(seed), "id", "mix_id"))
    times = F.size(F.filter("steps", lambda t: F.col("u") >= t))
    copies = used.withColumn("times", times).where("times > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("times"))))
    placed = copies.select("mix_id", "id", "source", "copy_no", "size", F.xxhash64(F.lit(seed + 1), "mix_id", "id", "copy_no").alias("place"))
    return placed.orderBy("mix_id", "place", "id", "copy_no")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target the size and the share that its mixture reached."""
    got = mixed.groupBy("mix_id", "source").agg(
        F.sum("size").alias("actual_size"), F.count("*").alias("uses"), F.countDistinct("id").alias("used_rows"), F.max("copy_no").alias("most_repeats")
    )
    whole = got.groupBy("mix_id").agg(F.sum("actual_size").alias("mixture_size"))
    asked = targets.select("mix_id", source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
    joined = asked.join(F.broadcast(got), ["mix_id", "source"], "left").join(F.broadcast(whole), "mix_id", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "mix_id", "source", "target_share", "max_repeats",
        *(F.coalesce(c, zero).alias(c) for c in ("actual_size", "uses", "used_rows")),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce(F.col("actual_size") / F.nullif(F.col("mixture_size"), zero), F.lit(0.0)).alias("actual_share"),
    )
