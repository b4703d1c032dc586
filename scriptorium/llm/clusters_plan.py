"""Queries on groups of similar emails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import clusters
from scriptorium.session import cut
from scriptorium.tables import table


def _groups(spark: SparkSession, directory: str) -> DataFrame:
    return clusters.similar_groups(table(spark, directory, "email_vector"), "id", "embedding", "embedded_at")


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """The judged pairs whose emails are in one group."""
    groups = cut(_groups(spark, directory).where("cluster is not null").select("id", "cluster"))
    a = groups.select(F.col("id").alias("id_a"), F.col("cluster").alias("a"))
    b = groups.select(F.col("id").alias("id_b"), F.col("cluster").alias("b"))
    pairs = table(spark, directory, "cluster_pair").select("id_a", "id_b")
    return pairs.join(a, "id_a").join(b, "id_b").where("a = b").select("id_a", "id_b")


def p1_clusters(spark: SparkSession, directory: str) -> DataFrame:
    """Each group with its size and most typical emails."""
    return clusters.describe(_groups(spark, directory))


def p1_members(spark: SparkSession, directory: str) -> DataFrame:
    """Each email with a vector and its group, null for one like no other."""
    return _groups(spark, directory)


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters, "p1_members": p1_members}

ORACLES: dict[str, str] = {}
