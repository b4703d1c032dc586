"""Queries on the tokens of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import tokens
from scriptorium.tables import spread, table


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    """The token ids of each document."""
    documents = spread(table(spark, directory, "documents").select("doc_id", "text"))
    return tokens.token_ids(documents, "doc_id", "text", tokens.public(spark)).withColumnRenamed("id", "doc_id")


def p6_use(spark: SparkSession, directory: str) -> DataFrame:
    """How often each token id occurs in all documents."""
    ids = p6_ids(spark, directory)
    return ids.select(F.explode("ids").alias("token_id")).groupBy("token_id").agg(F.count("*").alias("uses"))


def p6_round(spark: SparkSession, directory: str) -> DataFrame:
    """Each document's text out of its token ids again."""
    ids, tokenizer = p6_ids(spark, directory), tokens.public(spark)
    return tokens.texts(ids, "ids", tokenizer, "text").select("doc_id", F.md5("text").alias("text_md5"))


QUERIES = {"p6_ids": p6_ids, "p6_use": p6_use, "p6_round": p6_round}

ORACLES = {"p6_round": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents"}
