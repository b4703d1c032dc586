"""Queries on near-duplicate emails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import near
from scriptorium.tables import table


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of emails of 20 words or more whose word triples are at least 0.6 alike."""
    return near.near_pairs(table(spark, directory, "email"), "id", "body", similarity=0.6, size=3, min_words=20)


def p3_groups(spark: SparkSession, directory: str) -> DataFrame:
    """Each email with its group of near-duplicates, by runs of five words and 0.8."""
    return near.near_groups(table(spark, directory, "email"), "id", "body", similarity=0.8, size=5, min_words=20)


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}

ORACLES = {
    "p3_found": r"""
WITH w AS (SELECT DISTINCT id, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS w FROM email WHERE id IS NOT NULL AND body IS NOT NULL),
t AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])) AS t FROM w WHERE len(w) >= 20),
n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.6 * (x.n + y.n - c)
"""
}
