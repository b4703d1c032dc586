"""Queries on the registry, on what validation suggests and on the work's state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from scriptorium.operators import groups, mail, profiles, registry
from scriptorium.plans import profiles as P
from scriptorium.plans.mail import _ORIGINAL
from scriptorium.session import checkpoint_dir
from scriptorium.tables import spread, table


def _samples(spark, directory):
    source = F.regexp_replace(F.lower(F.trim("source")), "[ -]", "_")
    return table(spark, directory, "samples").select("id", "persona_id", source.alias("source"), "excerpt").distinct()


def sta_create(spark, directory):
    """A profile of each persona's samples: count, confidence, sources, excerpts."""
    rows = registry.created(_samples(spark, directory))
    sources = F.array_join(F.transform(F.map_entries("sources"), lambda e: F.concat(F.coalesce(e["key"], F.lit("?")), F.lit("="), e["value"].cast("string"))), ",")
    return rows.select("persona_id", "sample_count", "confidence", sources.alias("sources"), F.md5(F.array_join("excerpts", "|")).alias("excerpts_md5"))


def _half(spark, directory, odd: bool):
    rows = table(spark, directory, "samples").where("persona_id is not null and id is not null").select("id", "persona_id", "excerpt").distinct()
    held = F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long") % 2 == int(odd)
    rows = rows.where(held)
    lists = rows.groupBy("persona_id").agg(F.array_sort(F.collect_set("id")).alias("sample_ids"))
    rule = F.array(F.concat(F.lit("rule "), F.lit("b" if odd else "a"))).alias("rules")
    return lists.join(registry.best_excerpts(rows, "persona_id", "excerpt", 4), "persona_id", "left").select("persona_id", "sample_ids", rule, "excerpts")


def sta_update(spark, directory):
    """A registry of half the samples, by hash, extended by the other half."""
    out = registry.updated(_half(spark, directory, False), _half(spark, directory, True))
    return out.select("persona_id", F.size("sample_ids").alias("n"), F.array_join("rules", ",").alias("rules"), F.md5(F.array_join("excerpts", "|")).alias("excerpts_md5"), "confidence")


def sta_flags(spark, directory):
    """Samples whose best profile is in doubt."""
    return registry.flagged(P.ml_assign(spark, directory))


def _draft(spark, directory):
    members = groups.members(table(spark, directory, "clusters")).where("not is_noise")
    lists = members.groupBy("run_id", "cluster").agg(F.array_sort(F.collect_set("id")).alias("sample_ids"))
    return lists.withColumn("persona", F.format_string("group_%s", F.col("cluster").cast("string")))


def sta_approve(spark, directory):
    """A draft of all runs saved, loaded, made batches and approved: samples a persona."""
    path = f"{checkpoint_dir(spark)}/draft-{uuid.uuid4().hex}"
    registry.save_draft(_draft(spark, directory), path)
    return registry.approved(registry.batches(registry.load_draft(spark, path))).groupBy("persona").agg(F.count("*").alias("n"))


def jsn_batches(spark, directory):
    """Groups of the runs as batches."""
    return registry.batches(_draft(spark, directory)).select("batch_id", "schema_version", F.size("samples").alias("n"), F.get("samples", F.lit(0))["id"].alias("first_id"))


def sta_state(spark, directory):
    """What each table of the work holds."""
    t = lambda n: table(spark, directory, n)
    email = t("email")
    parts = {
        "fetch": email.select("id").distinct(), "filter": mail.accept(spread(email)).where("reason = ''"), "group": t("clusters").where("clusters is not null"),
        "analyse": t("samples").where("persona_id is not null"), "validate": t("validation_pairs").where("expected_persona is not null"), "publish": t("personas").where("characteristics.formality > 10"),
    }
    return registry.state(parts, list(parts))


def val_suggest(spark, directory):
    """What validation suggests to change in profiles."""
    return profiles.suggestions(P._scored(spark, directory), table(spark, directory, "personas"), 0.75)


def val_mismatch(spark, directory):
    """The ten worst pairs for reading."""
    scored = P._scored(spark, directory)
    worst = profiles.mismatches(scored).select("id", "composite")
    v = table(spark, directory, "validation_pairs").select("id", F.col("ground_truth.reply_text").alias("reply")).dropDuplicates(["id"])
    rows = worst.join(scored.select("id", "subject", "quoted", "inferred_persona"), "id").join(v, "id")
    text = profiles.mismatch_text(F.col("subject"), F.col("quoted"), F.col("reply"), F.col("inferred_persona"), F.col("composite"))
    return rows.select("id", F.md5(text).alias("text_md5"), F.length(text).alias("n"))


def join_details(spark, directory):
    """Results joined with their pairs under whatever name each result's id has."""
    v = table(spark, directory, "validation_pairs").select("id").distinct()
    k = F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long") % 3
    results = v.select(*(F.when(k == i, F.col("id")).otherwise(F.lit("") if i else F.lit(None)).alias(c) for i, c in enumerate(("pair", "pair_id", "email_id"))))
    results = results.select(profiles.canonical_id("pair", "pair_id", "email_id").alias("id"), F.when(F.col("pair").isNotNull(), "id").when(F.col("pair_id") != "", "pair_id").otherwise("email_id").alias("under"))
    words = table(spark, directory, "validation_pairs").select("id", F.col("ground_truth.word_count").alias("word_count")).distinct()
    return results.join(words, "id").select("id", "under", "word_count")


def val_feedback(spark, directory):
    """Feedback recorded in a log with the inferred profile, and read again."""
    path = f"{checkpoint_dir(spark)}/feedback-{uuid.uuid4().hex}"
    rows = P.join_infer(spark, directory)
    good = F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long") % 4 > 0
    rows = rows.select(F.col("id").alias("pair_id"), F.col("inferred_persona").alias("persona"), good.alias("good"))
    registry.append(rows.where("good"), path)
    registry.append(rows.where("not good"), path)
    return profiles.feedback(spark.read.schema(rows.schema).parquet(path))


def val_gate(spark, directory):
    """Whether validation is complete: pairs scored, and votes (events) recorded."""
    return registry.gate(P._scored(spark, directory), table(spark, directory, "events").where("event_type in ('purchase', 'error')"))


def val_models(spark, directory):
    """Parts as a catalog of models: those newer than the middle of the keys that take and give text."""
    p = table(spark, directory, "part")
    k = F.col("p_partkey")
    kinds = lambda bit: F.when((k / bit).cast("long") % 2 == 0, F.array(F.lit("text"), F.lit("image"))).otherwise(F.array(F.lit("image")))
    catalog = p.select(k.alias("id"), (k * 7919 % 1009).alias("created"), kinds(1).alias("inputs"), kinds(2).alias("outputs"))
    return registry.models(catalog, F.lit(500)).select("id", "created")


def join_renamed(spark, directory):
    """Samples by profile after profiles were merged."""
    into = spark.createDataFrame([("per_02", "per_01"), ("per_04", "per_03")], "old string, new string")
    rows = profiles.renamed(table(spark, directory, "samples").select("id", F.col("persona_id").alias("persona")).distinct(), into)
    return rows.groupBy("persona").agg(F.count("*").alias("n"))


def ml_leaders(spark, directory):
    """Samples grouped anew by the first of them that they are like, as those are that no profile takes."""
    return profiles.leaders(P._analysed(spark, directory))


QUERIES = {
    f.__name__: f
    for f in (
        sta_create, sta_update, sta_flags, sta_approve, jsn_batches, sta_state, val_suggest, val_mismatch, join_details, val_feedback, val_gate, val_models, join_renamed, ml_leaders,
    )
}

_ASSIGN = P.ORACLES["ml_assign"]
_SM = "sm AS (SELECT DISTINCT id, persona_id, regexp_replace(lower(trim(source)), '[ -]', '_', 'g') AS source, excerpt FROM samples)"
_EX = "ex AS (SELECT persona_id, list(e ORDER BY e) AS es FROM (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY e) AS k FROM (SELECT DISTINCT persona_id, excerpt AS e FROM {0} WHERE excerpt IS NOT NULL AND persona_id IS NOT NULL)) WHERE k <= {1} GROUP BY 1)"
_DRAFT = """c AS (SELECT run_id, unnest(clusters) AS c FROM clusters), m AS (SELECT run_id, c.id AS cluster, unnest(c.sample_ids) AS id FROM c WHERE NOT coalesce(c.is_noise, false) AND c.sample_ids IS NOT NULL),
d AS (SELECT run_id, cluster, list_sort(list_distinct(list(id))) AS ids FROM m WHERE id IS NOT NULL GROUP BY 1, 2)"""
_HASH = "('0x' || substr(md5({0}), 1, 6))::BIGINT"
_SD = P._V

ORACLES = {
    "sta_state": f"""WITH {_ORIGINAL}, t AS (SELECT 0 AS p, 'fetch' AS step, (SELECT count(DISTINCT id) FROM email) AS rows UNION ALL SELECT 1, 'filter', (SELECT count(*) FROM f WHERE reason = '') UNION ALL SELECT 2, 'group', (SELECT count(*) FROM clusters WHERE clusters IS NOT NULL)
      UNION ALL SELECT 3, 'analyse', (SELECT count(*) FROM samples WHERE persona_id IS NOT NULL) UNION ALL SELECT 4, 'validate', (SELECT count(*) FROM validation_pairs WHERE expected_persona IS NOT NULL) UNION ALL SELECT 5, 'publish', (SELECT count(*) FROM personas WHERE characteristics.formality > 10))
      SELECT step, rows, rows > 0 AS done, p = (SELECT min(p) FROM t WHERE rows = 0) AS current FROM t""",
    "sta_create": f"""WITH {_SM}, n AS (SELECT persona_id, source, count(DISTINCT id) AS n FROM sm WHERE persona_id IS NOT NULL GROUP BY 1, 2), {_EX.format('sm', 5)}
      SELECT n.persona_id, sum(n)::BIGINT AS sample_count, round(least(0.5 + 0.05*sum(n), 0.95), 6)::DOUBLE AS confidence, string_agg(coalesce(source, '?') || '=' || n, ',' ORDER BY source) AS sources, md5(array_to_string(any_value(es), '|')) AS excerpts_md5 FROM n LEFT JOIN ex USING (persona_id) GROUP BY 1""",
    "sta_update": f"""WITH s AS (SELECT DISTINCT id, persona_id, excerpt, {_HASH.format('id')} % 2 AS h FROM samples WHERE persona_id IS NOT NULL AND id IS NOT NULL), a AS (SELECT * FROM s WHERE h = 0), b AS (SELECT * FROM s WHERE h = 1),
      ea AS (SELECT persona_id, list(e ORDER BY e) AS es FROM (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY e) AS k FROM (SELECT DISTINCT persona_id, excerpt AS e FROM a WHERE excerpt IS NOT NULL)) WHERE k <= 4 GROUP BY 1),
      eb AS (SELECT persona_id, list(e ORDER BY e) AS es FROM (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY e) AS k FROM (SELECT DISTINCT persona_id, excerpt AS e FROM b WHERE excerpt IS NOT NULL)) WHERE k <= 4 GROUP BY 1),
      na AS (SELECT persona_id, list(DISTINCT id) AS i FROM a GROUP BY 1), nb AS (SELECT persona_id, list(DISTINCT id) AS i FROM b GROUP BY 1),
      j AS (SELECT na.persona_id, len(list_distinct(list_concat(na.i, coalesce(nb.i, []))))::INT AS n, nb.i IS NOT NULL AS two, list_concat(coalesce(ea.es, []), coalesce(eb.es, []))[1:5] AS es FROM na LEFT JOIN nb USING (persona_id) LEFT JOIN ea USING (persona_id) LEFT JOIN eb USING (persona_id))
      SELECT persona_id, n, CASE WHEN two THEN 'rule a,rule b' ELSE 'rule a' END AS rules, md5(array_to_string(es, '|')) AS excerpts_md5, round(least(0.5 + 0.05*n, 0.95), 6)::DOUBLE AS confidence FROM j""",
    "sta_flags": f"SELECT id AS sample_id, printf('Ambiguous: best=%.0f%%', score * 100) AS reason, score FROM ({_ASSIGN}) WHERE status = 'flagged'",
    "sta_approve": f"WITH {_DRAFT}, r AS (SELECT 'group_' || cluster AS persona, unnest(ids) AS id FROM d), o AS (SELECT id, min(persona) AS persona FROM r GROUP BY 1) SELECT persona, count(*) AS n FROM o GROUP BY 1",
    "jsn_batches": f"WITH {_DRAFT} SELECT 'batch_' || run_id || '_' || cluster AS batch_id, '2.0' AS schema_version, len(ids)::INT AS n, ids[1] AS first_id FROM d WHERE len(ids) > 0",
    "val_suggest": f"""WITH {_SD}, z AS (SELECT sd.*, v.th, gt.greeting AS g0, gt.closing AS c0 FROM sd JOIN v USING (id) JOIN (SELECT DISTINCT ON (id) id, ground_truth.greeting AS greeting, ground_truth.closing AS closing FROM validation_pairs) gt USING (id)),
      a AS (SELECT inferred_persona AS p, count(*) AS n, avg(formality_score) AS f, avg(contractions_score) AS c, avg(greeting_score) AS g, avg(closing_score) AS e, count(*) FILTER (list_contains(th,'formal')) AS fo, count(*) FILTER (list_contains(th,'casual')) AS ca,
        count(*) FILTER (list_contains(th,'uses_contractions')) AS sh FROM z GROUP BY 1),
      gm AS (SELECT p, first(x ORDER BY k DESC, x) AS x FROM (SELECT inferred_persona AS p, g0 AS x, count(*) AS k FROM z WHERE coalesce(g0,'') <> '' GROUP BY 1, 2) GROUP BY 1),
      cm AS (SELECT p, first(x ORDER BY k DESC, x) AS x FROM (SELECT inferred_persona AS p, c0 AS x, count(*) AS k FROM z WHERE coalesce(c0,'') <> '' GROUP BY 1, 2) GROUP BY 1),
      q AS (SELECT a.*, gm.x AS gx, cm.x AS cx, ch.* FROM a LEFT JOIN gm USING (p) LEFT JOIN cm USING (p) LEFT JOIN (SELECT persona_id, characteristics.formality AS kf, characteristics.uses_contractions AS kc, characteristics.typical_greeting AS kg, characteristics.typical_closing AS ke FROM personas) ch ON ch.persona_id = a.p)
      SELECT p AS persona_id, 'formality' AS type, coalesce(kf::VARCHAR, '5') AS current, CASE WHEN fo > ca THEN 'Increase formality score' ELSE 'Decrease formality score' END AS suggestion FROM q WHERE f < 0.75 AND fo <> ca
      UNION ALL SELECT p, 'contractions', coalesce(kc::VARCHAR, 'true'), 'Set uses_contractions to ' || CASE WHEN sh > n/2 THEN 'true' ELSE 'false' END FROM q WHERE c < 0.75
      UNION ALL SELECT p, 'greeting', coalesce(kg, ''), 'Update typical_greeting to match: ' || chr(39) || gx || chr(39) FROM q WHERE g < 0.75 AND gx IS NOT NULL
      UNION ALL SELECT p, 'closing', coalesce(ke, ''), 'Update typical_closing to match: ' || chr(39) || cx || chr(39) FROM q WHERE e < 0.75 AND cx IS NOT NULL""",
    "val_mismatch": f"""WITH {_SD}, b AS (SELECT id, composite, inferred_persona FROM sd ORDER BY composite, id LIMIT 10), o AS (SELECT DISTINCT ON (id) id, coalesce(context.subject,'') AS s, coalesce(context.quoted_text,'') AS q, coalesce(ground_truth.reply_text,'') AS r FROM validation_pairs),
      t AS (SELECT id, 'Subject: ' || s || chr(10) || 'Context: ' || CASE WHEN length(q) > 200 THEN substr(q,1,200) || '...' ELSE q END || chr(10) || 'Actual: ' || CASE WHEN length(r) > 500 THEN substr(r,1,500) || '...' ELSE r END || chr(10) || 'Persona: ' || inferred_persona
        || ' (' || round_even(composite*100, 0)::INT || '%)' AS x FROM b JOIN o USING (id)) SELECT id, md5(x) AS text_md5, length(x) AS n FROM t""",
    "join_details": f"""SELECT DISTINCT id, CASE {_HASH.format('id')} % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'pair_id' ELSE 'email_id' END AS under, ground_truth.word_count AS word_count FROM validation_pairs""",
    "val_feedback": f"""WITH {_SD}, l AS (SELECT persona_id AS persona, {_HASH.format('id')} % 4 > 0 AS good FROM i), vo AS (SELECT persona, count(*) FILTER (good) AS pos, count(*) FILTER (NOT good) AS neg FROM l GROUP BY 1)
      SELECT persona, pos, neg, CASE WHEN neg > pos THEN 'needs_refinement' WHEN pos >= 3 AND neg = 0 THEN 'well_calibrated' ELSE 'mixed' END AS status, round(greatest(pos, neg)/(pos+neg), 6) AS confidence FROM vo""",
    "val_gate": f"""WITH {_SD}, s AS (SELECT count(*) AS pairs, round(avg(composite), 6) AS mean FROM sd), e AS (SELECT count(*) AS answers FROM events WHERE event_type IN ('purchase','error'))
      SELECT pairs, mean, answers, pairs > 0 AND mean >= 0.6 AS auto_complete, answers > 0 AS interactive_complete, pairs > 0 AND mean >= 0.6 AND answers > 0 AS complete FROM s, e""",
    "val_models": "SELECT p_partkey AS id, p_partkey*7919%1009 AS created FROM part WHERE p_partkey % 2 = 0 AND (p_partkey // 2) % 2 = 0 AND p_partkey*7919%1009 > 500",
    "join_renamed": "SELECT CASE persona_id WHEN 'per_02' THEN 'per_01' WHEN 'per_04' THEN 'per_03' ELSE persona_id END AS persona, count(*) AS n FROM (SELECT DISTINCT id, persona_id FROM samples) GROUP BY 1",
}
