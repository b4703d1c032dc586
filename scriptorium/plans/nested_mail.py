"""Queries on the nested mail payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import nested
from scriptorium.tables import spread, table


def _payloads(spark: SparkSession, directory: str) -> DataFrame:
    return spread(table(spark, directory, "email").select("id", "payload").where("payload is not null"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Each link from a node of a payload to its header or part."""
    payloads = _payloads(spark, directory)
    rows = nested.shred(payloads, "id", "payload", nested.layout_of(payloads, "payload"))
    return (
        rows.where(F.col("element").isin("headers", "parts"))
        .select(
            F.col("record").alias("id"),
            "parent_path",
            F.when(F.col("element") == "headers", "header").otherwise("part").alias("child_kind"),
            "child_no",
        )
        .distinct()
    )


def _flat(name: str):
    def query(spark: SparkSession, directory: str) -> DataFrame:
        payloads = _payloads(spark, directory)
        return nested.flat_tables(payloads, "id", "payload", names=[name])[name].distinct()

    return query


QUERIES = {"p4_found": p4_found, "p4_messages": _flat(nested.ROOT), "p4_parts": _flat("parts"), "p4_headers": _flat("headers")}

_READ = """
WITH RECURSIVE texts AS (
  SELECT DISTINCT id, payload FROM email WHERE payload IS NOT NULL AND json_valid(payload)
), roots AS (
  SELECT id, CASE WHEN json_type(payload) = 'VARCHAR' THEN json_extract_string(payload, '$') ELSE payload END AS doc FROM texts
), nodes AS (
  SELECT id, '' AS path, CAST(doc AS JSON) AS node FROM roots WHERE json_valid(doc) AND json_type(doc) = 'OBJECT'
  UNION ALL
  SELECT id, CASE WHEN path = '' THEN CAST(i AS VARCHAR) ELSE path || '.' || i END AS path, item AS node
  FROM (
    SELECT id, path, unnest(range(len(items))) AS i, unnest(items) AS item
    FROM (SELECT id, path, CASE json_type(node, '$.parts') WHEN 'ARRAY' THEN CAST(node->'$.parts' AS JSON[])
                           WHEN 'OBJECT' THEN [node->'$.parts'] END AS items FROM nodes) a WHERE items IS NOT NULL
  ) b WHERE item IS NOT NULL AND json_type(item) <> 'NULL'
)
"""

_LEAVES = """json_extract_string(n, '$.filename') AS filename, json_extract_string(n, '$.mimeType') AS "mimeType", json_extract_string(n, '$.partId') AS "partId",
  json_extract_string(n, '$.body.attachmentId') AS "body_attachmentId", json_extract_string(n, '$.body.data') AS body_data, json_extract_string(n, '$.body.size') AS body_size"""

ORACLES = {
    "p4_found": _READ
    + """
SELECT DISTINCT id, path AS parent_path, kind AS child_kind, CAST(i AS INTEGER) AS child_no FROM (
  SELECT id, path, kind, unnest(range(len(items))) AS i, unnest(items) AS item FROM (
    SELECT id, path, 'header' AS kind, CASE json_type(node, '$.headers') WHEN 'ARRAY' THEN CAST(node->'$.headers' AS JSON[])
           WHEN 'OBJECT' THEN [node->'$.headers'] END AS items FROM nodes
    UNION ALL
    SELECT id, path, 'part' AS kind, CASE json_type(node, '$.parts') WHEN 'ARRAY' THEN CAST(node->'$.parts' AS JSON[])
           WHEN 'OBJECT' THEN [node->'$.parts'] END AS items FROM nodes
  ) a WHERE items IS NOT NULL
) b WHERE item IS NOT NULL AND json_type(item) <> 'NULL'
""",
    "p4_messages": _READ
    + f"""SELECT id AS record, '' AS path, NULL::VARCHAR AS parent_element, NULL::VARCHAR AS parent_path, 0 AS child_no, {_LEAVES} FROM (SELECT DISTINCT id, node::VARCHAR AS n FROM nodes WHERE path = '')""",
    "p4_parts": _READ
    + f"""SELECT id AS record, path, CASE WHEN contains(path, '.') THEN 'parts' ELSE '$' END AS parent_element, regexp_replace(path, '[.]?[0-9]+$', '') AS parent_path,
  regexp_extract(path, '[0-9]+$')::INT AS child_no, {_LEAVES}, NULL::VARCHAR AS value FROM (SELECT DISTINCT id, path, node::VARCHAR AS n FROM nodes WHERE path <> '')""",
    "p4_headers": _READ
    + """SELECT DISTINCT id AS record, CASE WHEN path = '' THEN '' ELSE path || '.' END || i AS path, CASE WHEN path = '' THEN '$' ELSE 'parts' END AS parent_element, path AS parent_path, CAST(i AS INTEGER) AS child_no,
  json_extract_string(item, '$.name') AS name, json_extract_string(item, '$.value') AS value FROM (SELECT id, path, unnest(range(len(items))) AS i, unnest(items) AS item FROM (
    SELECT id, path, CASE json_type(node, '$.headers') WHEN 'ARRAY' THEN CAST(node->'$.headers' AS JSON[]) WHEN 'OBJECT' THEN [node->'$.headers'] END AS items FROM nodes) a WHERE items IS NOT NULL) b
  WHERE item IS NOT NULL AND json_type(item) <> 'NULL'""",
}
