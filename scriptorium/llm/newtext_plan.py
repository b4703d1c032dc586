"""Queries on what authors newly wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import newtext
from scriptorium.tables import spread, table


def _messages(spark: SparkSession, directory: str) -> DataFrame:
    email = spread(table(spark, directory, "email").select("id", "thread_id", "account_id", "sent_at", "body"))
    mails = email.select(
        F.col("id").alias("item"), F.lit("body").alias("field"), F.col("thread_id").alias("thread"),
        F.col("account_id").alias("sender"), F.col("sent_at").alias("at"), F.col("body").alias("text"),
    )
    pairs = spread(table(spark, directory, "validation_pairs").select("id", "context"))
    none = F.lit(None).cast("string")
    quoted = pairs.select(
        F.col("id").alias("item"), F.lit("quoted_text").alias("field"), none.alias("thread"), none.alias("sender"),
        F.lit(None).cast("timestamp").alias("at"), F.col("context.quoted_text").alias("text"),
    )
    return mails.unionByName(quoted)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Each line that its message's author did not newly write."""
    return newtext.old_lines(_messages(spark, directory)).select(F.col("item").alias("item_id"), "field", "line_no")


QUERIES = {"p5_found": p5_found}

ORACLES: dict[str, str] = {}
