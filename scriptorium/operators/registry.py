"""The registry of profiles: created, updated, flagged and approved in batches, and what its tables tell of the work's state.

Registries are tables; each operation is a plan whose result replaces or extends one. Ties
go by id; excerpts kept are those that sort first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCERPTS = 5


def confidence(samples: Column) -> Column:
    """How sure a profile of so many samples is."""
    return F.least(F.lit(0.5) + F.lit(0.05) * samples, F.lit(0.95))


def best_excerpts(samples: DataFrame, group: str, excerpt: str, most: int = EXCERPTS) -> DataFrame:
    """(group, excerpts): the first distinct excerpts of each group, ranked before they are gathered."""
    rows = samples.where(F.col(excerpt).isNotNull()).select(group, F.col(excerpt).alias("e")).distinct()
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy("e"))).where(F.col("k") <= most)
    return ranked.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda x: x["e"]).alias("excerpts"))


def created(samples: DataFrame) -> DataFrame:
    """(persona_id, sample_count, confidence, sources, excerpts) of samples (id, persona_id, source, excerpt)."""
    rows = samples.where("persona_id is not null")
    n = rows.groupBy("persona_id", "source").agg(F.countDistinct("id").alias("n"))
    sums = n.groupBy("persona_id").agg(F.sum("n").alias("sample_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n")))).alias("sources"))
    return sums.join(best_excerpts(rows, "persona_id", "excerpt"), "persona_id", "left").withColumn("confidence", F.round(confidence(F.col("sample_count")), 6))


def updated(registry: DataFrame, more: DataFrame) -> DataFrame:
    """A registry (persona_id, sample_ids, rules, excerpts) extended by rows of the same form; five excerpts stay, old ones first."""
    new = more.select("persona_id", *(F.col(c).alias(f"_{c}") for c in ("sample_ids", "rules", "excerpts")))
    both = lambda c: F.concat(F.coalesce(F.col(c), F.array().cast("array<string>")), F.coalesce(F.col(f"_{c}"), F.array().cast("array<string>")))
    out = registry.join(new, "persona_id", "left")
    return out.select(
        "persona_id", F.array_distinct(both("sample_ids")).alias("sample_ids"), F.array_distinct(both("rules")).alias("rules"), F.slice(both("excerpts"), 1, EXCERPTS).alias("excerpts"),
        F.round(confidence(F.size(F.array_distinct(both("sample_ids")))), 6).alias("confidence"),
    )


def flagged(assigned: DataFrame) -> DataFrame:
    """(sample_id, reason, score) of the samples that profiles.assign() flagged."""
    percent = F.format_string("Ambiguous: best=%.0f%%", F.col("score") * 100)
    return assigned.where("status = 'flagged'").select(F.col("id").alias("sample_id"), percent.alias("reason"), "score")


def batches(draft: DataFrame) -> DataFrame:
    """Rows of a draft (run_id, cluster, sample_ids, persona) as batches: batch_id, cluster, schema_version, samples; groups without samples make none."""
    rows = draft.where("size(sample_ids) > 0 and persona is not null")
    made = F.transform("sample_ids", lambda i: F.struct(i.alias("id"), F.col("persona").alias("persona")))
    return rows.select(F.format_string("batch_%s_%s", F.col("run_id").cast("string"), F.col("cluster").cast("string")).alias("batch_id"), "run_id", "cluster", F.lit("2.0").alias("schema_version"), made.alias("samples"))


def approved(batch: DataFrame) -> DataFrame:
    """(persona, id) of all batches, each sample once under the first of its personas; approving again changes nothing."""
    rows = batch.select(F.explode("samples").alias("s")).select("s.id", "s.persona").where("id is not null")
    return rows.groupBy("id").agg(F.min("persona").alias("persona"))


def save_draft(draft: DataFrame, path: str) -> None:
    draft.write.mode("overwrite").parquet(path)


def _fs(spark, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def has_draft(spark, path: str) -> bool:
    fs, target = _fs(spark, path)
    return bool(fs.exists(target))


def load_draft(spark, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if has_draft(spark, path) else None


def drop_draft(spark, path: str) -> bool:
    """Rejects a draft, or removes an approved one; whether there was one."""
    fs, target = _fs(spark, path)
    return bool(fs.delete(target, True))


def state(counts: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """(step, rows, done, current): what each table of the work holds; the current step is the first that is not done."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(i).alias("place"), F.lit(name).alias("step"), "rows") for i, name in enumerate(order) for df in [counts[name]]]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    first = Window.orderBy("place")  # a row a step
    open_ = F.sum(F.when(F.col("rows") == 0, 1).otherwise(0)).over(first.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("step", "rows", (F.col("rows") > 0).alias("done"), ((F.col("rows") == 0) & (open_ == 1)).alias("current"))


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a log: feedback, flags."""
    rows.write.mode("append").parquet(path)


def models(catalog: DataFrame, after: Column) -> DataFrame:
    """Models (id, created, inputs, outputs) newer than a time that read and write text, the newest first."""
    fit = F.array_contains("inputs", "text") & F.array_contains("outputs", "text") & (F.col("created") > after)
    return catalog.where(fit).orderBy(F.desc("created"), "id")


def gate(scored: DataFrame, log: DataFrame, least: float = 0.6) -> DataFrame:
    """One row: whether pairs were scored, well enough, and answered by a reader; complete where all hold."""
    auto = scored.agg(F.count("*").alias("pairs"), F.round(F.avg("composite"), 6).alias("mean"))
    read = log.agg(F.count("*").alias("answers"))
    rows = auto.join(read, F.lit(True))  # one row each
    ok = (F.col("pairs") > 0) & F.coalesce(F.col("mean") >= least, F.lit(False))
    return rows.select("pairs", "mean", "answers", ok.alias("auto_complete"), (F.col("answers") > 0).alias("interactive_complete"), (ok & (F.col("answers") > 0)).alias("complete"))
