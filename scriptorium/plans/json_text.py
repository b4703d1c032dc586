"""Queries on JSON held in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import json_text, style
from scriptorium.plans.style import ORACLES as ORACLES_OF_STYLE
from scriptorium.tables import spread, table


def _payloads(spark, directory):
    return spread(table(spark, directory, "email").select("id", "payload").where("payload is not null")).distinct()


def jsn_repair(spark, directory):
    """Payloads by whether they parse, parse once repaired, or don't."""
    p = _payloads(spark, directory).select(json_text.parsed(F.col("payload")).alias("p"))
    return p.groupBy(F.col("p.success").alias("success"), F.col("p.repaired").alias("repaired")).agg(F.count("*").alias("n"))


def jsn_commas(spark, directory):
    """Event properties with a stray comma put in and taken out again."""
    e = table(spark, directory, "events").select("event_id", F.replace("props", F.lit("}"), F.lit(", }")).alias("broken"))
    return e.select("event_id", F.regexp_replace("broken", r",(\s*[}\]])", "$1").alias("fixed"), F.get_json_object(F.regexp_replace("broken", r",(\s*[}\]])", "$1"), "$.k").alias("k"))


def jsn_merge(spark, directory):
    """Profiles as JSON, their empty fields filled from a default."""
    p = table(spark, directory, "personas")
    filled = json_text.merged(F.to_json("characteristics"), F.lit('{"typical_greeting": "Hello", "typical_closing": "Best", "formality": 5}'))
    return p.select("persona_id", F.get_json_object(filled, "$.typical_greeting").alias("greeting"), F.get_json_object(filled, "$.formality").alias("formality"))


def jsn_version(spark, directory):
    """Schema versions of batches: made from runs, some stating theirs."""
    c = table(spark, directory, "clusters")
    data = F.when(F.col("run_id") % 3 == 0, F.lit('{"schema_version": "2.1"}')).when(F.col("run_id") % 3 == 1, F.lit('{"voice_fingerprint": {}}')).otherwise(F.lit("{}"))
    n = F.col("run_id").cast("string")
    batch = F.when(F.col("run_id") % 4 == 0, F.lit('{"samples": []}')).when(F.col("run_id") % 4 == 1, F.concat(F.lit('{"samples": [{"id": "'), n, F.lit('"}]}')))
    batch = batch.when(F.col("run_id") % 4 == 2, F.concat(F.lit('{"samples": [{"id": "'), n, F.lit('", "persona": "p"}]}'))).otherwise(F.lit('{"samples": [{"persona": "p"}]}'))
    return c.select("run_id", json_text.version(data).alias("version"), json_text.batch_errors(batch).alias("error"))


def jsn_migrate(spark, directory):
    return json_text.migrate(table(spark, directory, "personas"))


def _confident(spark, directory):
    """Samples with a persona and a confidence from 0.5 to 0.99, by hash."""
    s = table(spark, directory, "samples").where("persona_id is not null and email_id is not null").select(F.col("email_id").alias("id"), "persona_id").distinct()
    return s.withColumn("confidence", (F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long") % 50 + 50) / 100)


def flt_bank(spark, directory):
    """Each profile's example bank."""
    return json_text.example_bank(_confident(spark, directory), "persona_id")


def join_bank(spark, directory):
    """The banks' examples with names and texts."""
    names = table(spark, directory, "personas").select("persona_id", F.col("persona_name").alias("name"))
    mails = table(spark, directory, "email").select("id", "body").groupBy("id").agg(F.min("body").alias("body"))
    rows = json_text.with_sources(flt_bank(spark, directory), names, mails, "persona_id")
    return rows.select("persona_id", "rank", "id", "name", F.md5("example").alias("example_md5"))


def _sections(spark, directory):
    c = lambda f: F.col(f"characteristics.{f}").alias(f)
    p = table(spark, directory, "personas")
    parts = [F.when(F.col("characteristics").isNotNull(), F.struct(*(c(f) for f in fields))).alias(n) for n, fields in json_text.SECTIONS.items()]
    return p.select("persona_id", F.to_json(F.struct(*parts)).alias("data"))


def jsn_structure(spark, directory):
    """What profiles lack, and how many of their fields are filled."""
    n, total = json_text.completed(F.col("data"))
    return _sections(spark, directory).select("persona_id", F.array_join(json_text.structure_warnings(F.col("data")), ",").alias("warnings"), n.alias("filled"), F.lit(total).alias("total"))


def jsn_retry(spark, directory):
    """Prompts to try again where a profile is not complete."""
    rows = jsn_structure(spark, directory).where("warnings <> ''")
    return rows.select("persona_id", F.md5(json_text.retry_prompt(F.lit("Describe the profile."), F.col("warnings"))).alias("prompt_md5"))


def jsn_metrics(spark, directory):
    """Accounts' answers with the measured rates written over theirs."""
    email = spread(table(spark, directory, "email"))
    answers = email.select("account_id").distinct().select("account_id", F.lit("answered").alias("summary"), F.lit(0.5).alias("uses_bullets_rate"), F.lit(-1.0).alias("avg_words_per_sentence"))
    measured = style.formatting(email, "account_id").select("account_id", "uses_bullets_rate").join(style.rhythm(email, "account_id").select("account_id", "avg_words_per_sentence"), "account_id", "left")
    return json_text.with_metrics(answers, measured, "account_id", ["uses_bullets_rate", "avg_words_per_sentence"])


def join_notes(spark, directory):
    """Examples of each profile with notes of the same place."""
    p = table(spark, directory, "personas")
    e = lambda t, w, c: F.struct(F.lit(t).alias("text"), w.cast("string").alias("why"), c.cast("string").alias("context"))
    n = lambda w, c: F.struct(F.lit(w).alias("why"), F.lit(c).alias("context"))
    examples = p.select("persona_id", F.array(e("one", F.lit(" "), F.lit(None)), e("two", F.col("persona_name"), F.lit("kept")), e("three", F.lit(None), F.lit(""))).alias("examples"))
    notes = p.where("characteristics is not null").select("persona_id", F.array(n("w1", "c1"), n("w2", "c2")).alias("notes"))
    return json_text.merged_examples(examples, notes, "persona_id")


QUERIES = {f.__name__: f for f in (jsn_repair, jsn_commas, jsn_merge, jsn_version, jsn_migrate, flt_bank, join_bank, jsn_structure, jsn_retry, jsn_metrics, join_notes)}

_BANK = """s AS (SELECT DISTINCT email_id AS id, persona_id, (('0x' || substr(md5(email_id), 1, 6))::BIGINT % 50 + 50) / 100 AS confidence FROM samples WHERE persona_id IS NOT NULL AND email_id IS NOT NULL),
k AS (SELECT persona_id, row_number() OVER (PARTITION BY persona_id ORDER BY confidence DESC, id)::INT AS rank, id, confidence FROM s WHERE confidence >= 0.85), bk AS (SELECT * FROM k WHERE rank <= 5)"""
_SECTION = """q AS (SELECT persona_id, characteristics IS NULL AS x, characteristics AS c FROM personas), w AS (SELECT persona_id, x, list_filter([
  CASE WHEN x THEN 'no voice' END, CASE WHEN NOT x AND c.formality IS NULL THEN 'no voice.formality' END, CASE WHEN NOT x AND c.warmth IS NULL THEN 'no voice.warmth' END, CASE WHEN NOT x AND c.authority IS NULL THEN 'no voice.authority' END,
  CASE WHEN NOT x AND c.directness IS NULL THEN 'no voice.directness' END, CASE WHEN x THEN 'no opening' END, CASE WHEN NOT x AND coalesce(trim(c.typical_greeting), '') = '' THEN 'no opening.typical_greeting' END, CASE WHEN x THEN 'no closing' END,
  CASE WHEN NOT x AND coalesce(trim(c.typical_closing), '') = '' THEN 'no closing.typical_closing' END, CASE WHEN x THEN 'no mechanics' END, CASE WHEN NOT x AND c.uses_contractions IS NULL THEN 'no mechanics.uses_contractions' END], lambda v: v IS NOT NULL) AS ws FROM q),
sc AS (SELECT persona_id, array_to_string(ws, ',') AS warnings, (CASE WHEN x THEN 0 ELSE 7 - len(ws) END)::INT AS filled, 7 AS total FROM w)"""

ORACLES = {
    "jsn_commas": r"""SELECT event_id, regexp_replace(b, ',(\s*[}\]])', '\1', 'g') AS fixed, json_extract_string(regexp_replace(b, ',(\s*[}\]])', '\1', 'g'), '$.k') AS k
      FROM (SELECT event_id, replace(props, '}', ', }') AS b FROM events)""",
    "jsn_merge": """SELECT persona_id, coalesce(nullif(trim(characteristics.typical_greeting), ''), 'Hello') AS greeting, coalesce(characteristics.formality, 5)::VARCHAR AS formality FROM personas""",
    "jsn_version": """SELECT run_id, CASE run_id % 3 WHEN 0 THEN '2.1' WHEN 1 THEN '2.0' ELSE '1.0' END AS version, CASE run_id % 4 WHEN 0 THEN 'no samples' WHEN 2 THEN '' ELSE 'sample without id or persona' END AS error FROM clusters""",
    "flt_bank": f"WITH {_BANK} SELECT * FROM bk",
    "join_bank": f"""WITH {_BANK}, e AS (SELECT id, min(body) AS body FROM email GROUP BY 1) SELECT persona_id, rank, id, persona_name AS name, md5(substr(coalesce(body, ''), 1, 1000)) AS example_md5 FROM bk JOIN personas USING (persona_id) JOIN e USING (id)""",
    "jsn_structure": f"WITH {_SECTION} SELECT * FROM sc",
    "jsn_retry": f"""WITH {_SECTION} SELECT persona_id, md5('Describe the profile.' || chr(10) || chr(10) || 'The last answer was no valid JSON: ' || warnings || chr(10) || 'Answer with one JSON object only: no text around it, no comma before a closing bracket, all brackets closed.') AS prompt_md5 FROM sc WHERE warnings <> ''""",
    "jsn_metrics": f"""SELECT a.account_id, 'answered' AS summary, coalesce(f.uses_bullets_rate, 0.5) AS uses_bullets_rate, coalesce(r.avg_words_per_sentence, -1.0) AS avg_words_per_sentence FROM (SELECT DISTINCT account_id FROM email) a
      LEFT JOIN ({ORACLES_OF_STYLE['agg_formatting']}) f USING (account_id) LEFT JOIN ({ORACLES_OF_STYLE['agg_rhythm']}) r USING (account_id)""",
    "join_notes": """WITH e AS (SELECT persona_id, persona_name, characteristics IS NOT NULL AS h FROM personas) SELECT persona_id, 0 AS pos, 'one' AS text, CASE WHEN h THEN 'w1' END AS why, CASE WHEN h THEN 'c1' END AS context FROM e
      UNION ALL SELECT persona_id, 1, 'two', coalesce(nullif(trim(persona_name), ''), CASE WHEN h THEN 'w2' END), 'kept' FROM e UNION ALL SELECT persona_id, 2, 'three', NULL, NULL FROM e""",
    "jsn_migrate": """SELECT persona_id, '2.0' AS schema_version, coalesce(characteristics.formality, 5) AS formality, coalesce(characteristics.warmth, 5) AS warmth, coalesce(characteristics.authority, 5) AS authority, coalesce(characteristics.directness, 5) AS directness,
      CASE WHEN coalesce(characteristics.uses_contractions, false) THEN 0.5 ELSE 0.0 END::DOUBLE AS contraction_rate, coalesce(characteristics.typical_greeting, 'Hi {name},') AS greeting, coalesce(characteristics.typical_closing, 'Best,') AS closing FROM personas""",
}
