"""Queries on the pieces of long documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm import pieces, tokens
from scriptorium.tables import spread, table

#: piece_limit is a fixed table; more limits than this are refused.
MAX_LIMITS = 1000


def _pieces(spark: SparkSession, directory: str, only: int | None = None) -> DataFrame:
    limits = table(spark, directory, "piece_limit")
    if only is not None:
        limits = limits.where(F.col("limit_id") == only)
    rows = limits.orderBy("limit_id").limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} limits")
    documents = spread(table(spark, directory, "documents").select("doc_id", "text"))
    out = None
    for name in sorted({r.tokenizer for r in rows}):
        own = [pieces.Limit(r.limit_id, r.max_tokens, r.overlap_tokens) for r in rows if r.tokenizer == name]
        part = pieces.pieces(documents, "doc_id", "text", own, tokens.public(spark, name))
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that limit 1 cuts."""
    return _pieces(spark, directory, only=1).where("piece_no = 1").select("doc_id").distinct()


def p8_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """All pieces of all documents under each limit."""
    return _pieces(spark, directory)


def p8_whole(spark: SparkSession, directory: str) -> DataFrame:
    """Each document put together from its pieces under each limit, what two pieces share taken once."""
    p = _pieces(spark, directory).select("doc_id", "limit_id", "piece_no", "start_char", "end_char", "piece")
    before = F.lag("end_char").over(Window.partitionBy("doc_id", "limit_id").orderBy("piece_no"))
    own = p.withColumn("before", before).select("doc_id", "limit_id", "piece_no", F.expr("substring(piece, greatest(coalesce(before, start_char) - start_char, 0) + 1)").alias("own"))
    whole = own.groupBy("doc_id", "limit_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "own"))).alias("l"))
    return whole.select("doc_id", "limit_id", F.md5(F.array_join(F.transform("l", lambda x: x["own"]), "")).alias("text_md5"))


QUERIES = {"p8_found": p8_found, "p8_pieces": p8_pieces, "p8_whole": p8_whole}

ORACLES = {"p8_whole": "SELECT doc_id, limit_id, md5(text) AS text_md5 FROM documents, piece_limit WHERE text IS NOT NULL AND text <> ''"}
