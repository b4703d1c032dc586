"""Queries on mixtures of document sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import mixture, tokens
from scriptorium.session import cut
from scriptorium.tables import spread, table


def _sizes(spark: SparkSession, directory: str) -> DataFrame:
    """(id, source, size) of all documents, counted once."""
    documents = spread(table(spark, directory, "documents").select("doc_id", "source", "text"))
    counted = tokens.with_token_count(documents, "text", tokens.public(spark), "size")
    return cut(counted.select(F.col("doc_id").alias("id"), mixture.source_key(F.col("source")).alias("source"), F.col("size").cast("long").alias("size")))


def p7_mixture(spark: SparkSession, directory: str) -> DataFrame:
    """Each use of a document in each mixture, in the mixture's order."""
    mixed = mixture.mixtures(_sizes(spark, directory), table(spark, directory, "mix_target"))
    return mixed.withColumnRenamed("id", "doc_id").withColumnRenamed("size", "n_tokens")


def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    """Target and actual share of each source of each mixture."""
    targets = table(spark, directory, "mix_target")
    return mixture.shares(mixture.mixtures(_sizes(spark, directory), targets), targets)


def p7_kept(spark: SparkSession, directory: str) -> DataFrame:
    """For each target whether its mixture keeps to the repeats and the share it was to reach, where its documents suffice.

    A source suffices that could be used again: one below `max_repeats` in every document
    reached its share within a fiftieth of the mixture or the size of one document.
    """
    sizes, targets = _sizes(spark, directory), table(spark, directory, "mix_target")
    got = mixture.shares(mixture.mixtures(sizes, targets), targets)
    whole = sizes.agg(F.sum("size").alias("all"), F.max("size").alias("largest"))
    asked = targets.select("mix_id", mixture.source_key(F.col("source")).alias("source"), "corpus_share")
    have = sizes.groupBy("source").agg(F.sum("size").alias("have"))
    rows = got.join(asked, ["mix_id", "source"]).join(have, "source", "left").join(whole, F.lit(True))
    want = F.col("target_share") * F.col("corpus_share") * F.col("all")
    reached = F.abs(F.col("actual_size") - want) <= F.greatest(want / 50, F.col("largest"))
    enough = F.coalesce("have", F.lit(0)) * F.col("max_repeats") >= want
    return rows.select("mix_id", "source", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_repeats"), (reached | ~enough).alias("share_reached"))


QUERIES = {"p7_mixture": p7_mixture, "p7_shares": p7_shares, "p7_kept": p7_kept}

#: What every mixture must keep to.
ORACLES = {"p7_kept": "SELECT mix_id, replace(lower(trim(source)), '-', '_') AS source, true AS within_repeats, true AS share_reached FROM mix_target"}
