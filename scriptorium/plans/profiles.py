"""Queries on writing profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import mail, profiles, style
from scriptorium.functions import text as T
from scriptorium.tables import table


def _pairs(spark, directory):
    v = table(spark, directory, "validation_pairs")
    return v.select(
        "id", F.col("context.subject").alias("subject"), F.col("context.quoted_text").alias("quoted"), F.col("metadata.sender").alias("sender"), F.col("ground_truth.tone_hints").alias("tone_hints"),
        F.col("ground_truth.greeting").alias("greeting"), F.col("ground_truth.closing").alias("closing"), F.col("ground_truth.has_contractions").alias("has_contractions"),
    ).dropDuplicates(["id"])


def join_infer(spark, directory):
    """The profile that fits each pair's context best."""
    return profiles.infer(_pairs(spark, directory), table(spark, directory, "personas")).select("id", "inferred_persona", "confidence")


def _scored(spark, directory):
    personas = table(spark, directory, "personas")
    return profiles.score(profiles.infer(_pairs(spark, directory), personas), personas)


def val_scores(spark, directory):
    return _scored(spark, directory).select("id", "inferred_persona", "formality_score", "contractions_score", "warmth_score", "greeting_score", "closing_score", "composite")


def val_report(spark, directory):
    return profiles.report(_scored(spark, directory))


def srt_mismatches(spark, directory):
    return profiles.mismatches(_scored(spark, directory))


def cls_schema(spark, directory):
    return profiles.schema_checks(table(spark, directory, "personas"))


def _analysed(spark, directory):
    """Samples with traits of their mail's text."""
    s = table(spark, directory, "samples").select("id", "persona_id", "email_id").dropDuplicates(["id"])
    e = table(spark, directory, "email").groupBy(F.col("id").alias("email_id")).agg(F.min("body").alias("body"))
    body = F.replace(F.coalesce("body", F.lit("")), F.lit("\r"), F.lit(""))
    lines = T.filled(T.lines(body))
    last = F.when(F.size(lines) > 0, F.reverse(F.slice(lines, -F.least(F.size(lines), F.lit(5)), F.lit(5))))
    closing = F.get(F.filter(F.transform(last, lambda x: T.first_label(x, style.CLOSINGS)), lambda x: x.isNotNull()), F.lit(0))
    hints = mail.tone_hints(body)
    words, marks = F.size(F.regexp_extract_all(body, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))), F.greatest(F.size(F.regexp_extract_all(body, F.lit("[.!?]+"), F.lit(0))), F.lit(1))
    return s.join(e, "email_id").select(
        "id", "persona_id", hints.alias("tone"), F.when(F.array_contains(hints, "formal"), "formal").when(F.array_contains(hints, "casual"), "casual").otherwise("semi-formal").alias("formality"),
        F.coalesce(T.first_label(F.get(lines, F.lit(0)), style.GREETINGS), F.lit("")).alias("greeting"), F.coalesce(closing, F.lit("")).alias("closing"),
        F.when(F.array_contains(hints, "uses_contractions"), "frequent").otherwise("rare").alias("contractions"),
        F.when(words / marks < 8, "short").when(words / marks <= 20, "medium").otherwise("long").alias("sentence"), F.when(F.get(lines, F.lit(0)).contains("?"), "question").otherwise("statement").alias("hook"),
    )


def ml_assign(spark, directory):
    """Each sample's best profile by weighted likeness."""
    p = profiles.flat(table(spark, directory, "personas"))
    formality = F.when(F.col("formality") >= 8, "formal").when(F.col("formality") >= 6, "semi-formal").when(F.col("formality") >= 4, "casual-professional").otherwise("casual")
    tone = F.array_compact(F.array(F.when(F.col("formality") >= 7, F.lit("formal")), F.when(F.col("warmth") >= 7, F.lit("warm")), F.when(F.col("directness") >= 7, F.lit("concise"))))
    prof = p.select(
        "persona_id", tone.alias("tone"), formality.alias("formality"), F.col("typical_greeting").alias("greeting"), F.col("typical_closing").alias("closing"),
        F.when(F.col("p_contractions"), "frequent").otherwise("rare").alias("contractions"),
        F.when(F.col("directness") >= 7, "short").otherwise("medium").alias("sentence"), F.when(F.col("warmth") >= 7, "question").otherwise("statement").alias("hook"),
    )
    return profiles.assign(_analysed(spark, directory).drop("persona_id"), prof)


def grp_traits(spark, directory):
    """Traits of the samples recorded for each profile."""
    return profiles.traits(_analysed(spark, directory).where("persona_id is not null"), "persona_id")


def grp_rules(spark, directory):
    return profiles.rules(grp_traits(spark, directory).select("persona_id", "tone", "formality", "greeting", "closing", "contractions"))


def ml_names(spark, directory):
    """Pairs of profiles with their names' ratio; a matching of blocks that SQL lacks."""
    p = table(spark, directory, "personas").select("persona_id", "persona_name")
    a, b = p.select(F.col("persona_id").alias("id_a"), F.col("persona_name").alias("x")), p.select(F.col("persona_id").alias("id_b"), F.col("persona_name").alias("y"))
    return a.crossJoin(profiles.few(b)).where("id_a < id_b").select("id_a", "id_b", F.round(profiles.name_ratio(F.col("x"), F.col("y")), 6).alias("ratio"))


def grp_merge(spark, directory):
    """Profiles with per_02 folded into per_01 and per_04 into per_03."""
    return profiles.merge(table(spark, directory, "personas"), {"per_02": "per_01", "per_04": "per_03"})


def sta_upsert(spark, directory):
    """A registry of the first half of the profiles with a batch of all but the first written over it."""
    p = table(spark, directory, "personas")
    d = lambda text: F.lit(text).cast("date")
    old = p.where("persona_id <= 'per_05'").select(F.col("persona_id").alias("name"), F.lit("old").alias("description"), d("2024-01-01").alias("created"), d("2024-01-01").alias("updated"))
    new = p.where("persona_id > 'per_01'").select(F.col("persona_id").alias("name"), "description", d("2024-06-01").alias("updated"))
    return profiles.upsert(old, new, table(spark, directory, "samples").select("id", F.col("persona_id").alias("persona")))


def sta_new_samples(spark, directory):
    """Samples with a new hash; those created before 2023-07-01 are known."""
    s = table(spark, directory, "samples")
    return profiles.new_samples(s, s.where("created_at < timestamp'2023-07-01'").where("content_hash is not null"))


def grp_feedback(spark, directory):
    """Events as votes: a purchase is good, an error bad, the user the profile."""
    e = table(spark, directory, "events")
    good = F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False)
    return profiles.feedback(e.select(F.col("user_id").alias("persona"), good.alias("good")))


def set_missing(spark, directory):
    """Profiles that samples of mails name but the table of those with a greeting lacks, and the other way round."""
    named = table(spark, directory, "samples").where("persona_id is not null and persona_id <> 'per_03'").select("persona_id").distinct()
    known = table(spark, directory, "personas").where("characteristics.typical_greeting is not null").select("persona_id")
    return named.exceptAll(known).withColumn("side", F.lit("unknown")).unionByName(known.exceptAll(named).withColumn("side", F.lit("unused")))


def sta_export(spark, directory):
    """Samples by profile and source, spellings made one, with first and last time."""
    s = table(spark, directory, "samples").dropDuplicates(["id"])
    source = F.regexp_replace(F.lower(F.trim("source")), "[ -]", "_")
    return s.groupBy(F.coalesce("persona_id", F.lit("unassigned")).alias("persona_id"), source.alias("source")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        join_infer, val_scores, val_report, srt_mismatches, cls_schema, ml_assign, grp_traits, grp_rules, ml_names, grp_merge, sta_upsert, sta_new_samples, grp_feedback, set_missing, sta_export,
    )
}


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _groups(a: str, b: str, groups) -> str:
    return "(" + " OR ".join(f"({_any(a, g)} AND {_any(b, g)})" for g in groups) + ")"


_F = """fl AS (SELECT persona_id, lower(coalesce(description,'')) AS description, coalesce(characteristics.formality,5) AS formality, coalesce(characteristics.warmth,5) AS warmth, coalesce(characteristics.authority,5) AS authority,
 coalesce(characteristics.directness,5) AS directness, lower(coalesce(characteristics.typical_greeting,'')) AS tg, lower(coalesce(characteristics.typical_closing,'')) AS tc, coalesce(characteristics.uses_contractions,true) AS pc FROM personas)"""
_V = rf"""{_F}, v AS (SELECT DISTINCT ON (id) id, lower(coalesce(context.subject,'')) AS s, lower(coalesce(context.quoted_text,'')) AS q, lower(coalesce(metadata.sender,'')) AS f, coalesce(ground_truth.tone_hints, []) AS th,
 lower(coalesce(ground_truth.greeting,'')) AS gr, lower(coalesce(ground_truth.closing,'')) AS cl, coalesce(ground_truth.has_contractions,false) AS hc FROM validation_pairs),
x AS (SELECT v.*, persona_id, round(len(list_filter(string_split_regex(description, '\s+'), lambda w: length(w) > 4 AND (contains(s,w) OR contains(q,w) OR contains(f,w))))*0.2
 + CASE WHEN formality >= 7 THEN CASE WHEN {_any('s', profiles.FORMAL_SUBJECT)} THEN 0.3 ELSE 0 END + CASE WHEN {_any('f', profiles.FORMAL_SENDER)} THEN 0.3 ELSE 0 END WHEN formality <= 4 THEN CASE WHEN {_any('s', profiles.CASUAL_SUBJECT)} THEN 0.3 ELSE 0 END ELSE 0 END, 6)::DOUBLE AS sc FROM v CROSS JOIN fl),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sc DESC, persona_id) AS k FROM x), i AS (SELECT *, CASE WHEN sc > 0 THEN least(sc, 1.0) ELSE 0.3 END::DOUBLE AS confidence FROM r WHERE k = 1),
sc AS (SELECT id, persona_id AS inferred_persona, CASE WHEN list_contains(th,'formal') THEN CASE WHEN formality>=6 THEN 1.0 WHEN formality>=4 THEN 0.5 ELSE 0.2 END WHEN list_contains(th,'casual') THEN CASE WHEN formality<=4 THEN 1.0 WHEN formality<=6 THEN 0.5 ELSE 0.2 END ELSE 0.7 END::DOUBLE AS formality_score,
 CASE WHEN hc=pc THEN 1.0 WHEN hc THEN 0.3 ELSE 0.5 END::DOUBLE AS contractions_score, CASE WHEN list_contains(th,'warm') THEN CASE WHEN warmth>=6 THEN 1.0 WHEN warmth>=4 THEN 0.5 ELSE 0.2 END ELSE 0.7 END::DOUBLE AS warmth_score,
 CASE WHEN gr='' OR tg='' THEN 0.7 WHEN {_groups('gr', 'tg', profiles.GREETING_GROUPS)} THEN 1.0 ELSE 0.5 END::DOUBLE AS greeting_score, CASE WHEN cl='' OR tc='' THEN 0.7 WHEN {_groups('cl', 'tc', profiles.CLOSING_GROUPS)} THEN 1.0 ELSE 0.5 END::DOUBLE AS closing_score FROM i JOIN fl USING (persona_id)),
sd AS (SELECT *, round((formality_score+contractions_score+warmth_score+greeting_score+closing_score)/5, 6) AS composite FROM sc)"""
_S = r"regexp_replace({}, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')"
_C = "|".join(c for c in mail.CONTRACTIONS if c != "let's").replace("'", "''")


def _case(labels) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{label}'" for p, label in labels) + " END"


_A = rf"""s AS (SELECT DISTINCT ON (id) id, persona_id, email_id FROM samples ORDER BY id), e AS (SELECT id AS email_id, replace(coalesce(min(body),''), chr(13), '') AS b FROM email GROUP BY 1),
l AS (SELECT s.id, persona_id, b, list_filter(list_transform(string_split(b, chr(10)), lambda x: {_S.format('x')}), lambda x: x <> '') AS ls FROM s JOIN e USING (email_id)),
h AS (SELECT *, CASE WHEN b='' THEN [] ELSE list_filter([CASE WHEN regexp_matches(lower(b), 'dear |sincerely|kind regards|respectfully') THEN 'formal' END, CASE WHEN regexp_matches(lower(b), 'hey |lol|haha|!!') THEN 'casual' END,
  CASE WHEN regexp_matches(lower(b), 'hope you|thank you so much|really appreciate|wonderful') THEN 'warm' END, CASE WHEN length(b)-length(replace(b,'?','')) > 2 THEN 'inquisitive' END, CASE WHEN length(b)<100 THEN 'concise' END, CASE WHEN length(b)>500 THEN 'detailed' END,
  CASE WHEN regexp_matches(replace(replace(b,'’',''''),'‘',''''), '(?i)\b(?:{_C})\b') THEN 'uses_contractions' END], lambda x: x IS NOT NULL) END AS tone FROM l),
an AS (SELECT id, persona_id, tone, CASE WHEN list_contains(tone,'formal') THEN 'formal' WHEN list_contains(tone,'casual') THEN 'casual' ELSE 'semi-formal' END AS formality,
 coalesce(list_transform(ls[1:1], lambda x: {_case(style.GREETINGS)})[1], '') AS greeting, coalesce(list_filter(list_transform(list_reverse(ls[-5:]), lambda x: {_case(style.CLOSINGS)}), lambda y: y IS NOT NULL)[1], '') AS closing,
 CASE WHEN list_contains(tone,'uses_contractions') THEN 'frequent' ELSE 'rare' END AS contractions, len(regexp_extract_all(b, '[\p{{L}}\p{{N}}_]+')) / greatest(len(regexp_extract_all(b, '[.!?]+')), 1) AS wl,
 CASE WHEN wl < 8 THEN 'short' WHEN wl <= 20 THEN 'medium' ELSE 'long' END AS sentence, CASE WHEN contains(ls[1], '?') THEN 'question' ELSE 'statement' END AS hook FROM h)"""
_TRAITS = f"""{_A}, pa AS (SELECT * FROM an WHERE persona_id IS NOT NULL), n AS (SELECT persona_id, count(*) AS n FROM pa GROUP BY 1), tt AS (SELECT persona_id, unnest(tone) AS t FROM pa),
tn AS (SELECT tt.persona_id, t FROM tt JOIN n USING (persona_id) GROUP BY tt.persona_id, t, n.n HAVING count(*) >= 0.5*n.n), tl AS (SELECT persona_id, string_agg(t, ',' ORDER BY t) AS tone FROM tn GROUP BY 1),
u AS (UNPIVOT (SELECT persona_id, formality, greeting, closing, contractions, sentence FROM pa) ON formality, greeting, closing, contractions, sentence INTO NAME k VALUE v), uc AS (SELECT persona_id, k, v, count(*) AS c FROM u WHERE v <> '' GROUP BY ALL),
um AS (SELECT persona_id, k, max(c) AS c, first(v ORDER BY c DESC, v) AS v FROM uc GROUP BY 1, 2), ub AS (SELECT um.persona_id, max(v) FILTER (k='formality') AS formality, max(v) FILTER (k='contractions') AS contractions, max(v) FILTER (k='sentence') AS sentence,
 max(v) FILTER (k='greeting' AND c >= 0.3*n) AS greeting, max(v) FILTER (k='closing' AND c >= 0.3*n) AS closing FROM um JOIN n USING (persona_id) GROUP BY 1),
tr AS (SELECT n.persona_id, n.n, formality, contractions, sentence, greeting, closing, coalesce(tone, '') AS tone FROM n LEFT JOIN ub USING (persona_id) LEFT JOIN tl USING (persona_id))"""
_SIM = lambda a, b: f"(lower({a}) = lower({b}) OR {_groups(f'lower({a})', f'lower({b})', profiles.OPENER_GROUPS)})"

ORACLES = {
    "join_infer": f"WITH {_V} SELECT id, persona_id AS inferred_persona, confidence FROM i",
    "val_scores": f"WITH {_V} SELECT * FROM sd",
    "val_report": f"""WITH {_V} SELECT inferred_persona, count(*) AS pairs, round(avg(formality_score)*100,2) AS formality_score, round(avg(contractions_score)*100,2) AS contractions_score, round(avg(warmth_score)*100,2) AS warmth_score,
      round(avg(greeting_score)*100,2) AS greeting_score, round(avg(closing_score)*100,2) AS closing_score, round(avg(composite)*100,2) AS composite, round(avg(composite)*100,2) < 60 AS needs_refinement FROM sd GROUP BY 1""",
    "srt_mismatches": f"""WITH {_V}, b AS (SELECT * FROM sd ORDER BY composite, id LIMIT 10), u AS (UNPIVOT (SELECT id, composite, formality_score, contractions_score, warmth_score, greeting_score, closing_score FROM b) ON formality_score, contractions_score, warmth_score, greeting_score, closing_score INTO NAME c VALUE s),
      rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, c) AS k FROM u) SELECT id, composite, max(c) FILTER (k=1) AS weakest, max(c) FILTER (k=2) AS second FROM rk GROUP BY 1, 2""",
    "cls_schema": """WITH e AS (SELECT persona_id, list_filter([CASE WHEN coalesce(description,'')='' THEN 'no description' END, CASE WHEN characteristics IS NULL THEN 'no characteristics' END,
      CASE WHEN characteristics IS NOT NULL AND characteristics.formality IS NULL THEN 'no formality' END, CASE WHEN characteristics IS NOT NULL AND characteristics.warmth IS NULL THEN 'no warmth' END,
      CASE WHEN characteristics IS NOT NULL AND characteristics.authority IS NULL THEN 'no authority' END, CASE WHEN characteristics IS NOT NULL AND characteristics.directness IS NULL THEN 'no directness' END,
      CASE WHEN characteristics.formality NOT BETWEEN 1 AND 10 THEN 'formality out of range' END, CASE WHEN characteristics.warmth NOT BETWEEN 1 AND 10 THEN 'warmth out of range' END,
      CASE WHEN characteristics.authority NOT BETWEEN 1 AND 10 THEN 'authority out of range' END, CASE WHEN characteristics.directness NOT BETWEEN 1 AND 10 THEN 'directness out of range' END], lambda x: x IS NOT NULL) AS er,
      characteristics.formality = characteristics.warmth AND characteristics.warmth = characteristics.authority AND characteristics.authority = characteristics.directness AS eq FROM personas)
      SELECT persona_id, len(er) = 0 AS valid, array_to_string(er, '; ') AS errors, CASE WHEN eq THEN 'all scores equal' ELSE '' END AS warnings FROM e""",
    "ml_assign": f"""WITH {_F}, {_A}, p AS (SELECT persona_id, list_filter([CASE WHEN formality>=7 THEN 'formal' END, CASE WHEN warmth>=7 THEN 'warm' END, CASE WHEN directness>=7 THEN 'concise' END], lambda x: x IS NOT NULL) AS pt,
      CASE WHEN formality>=8 THEN 4 WHEN formality>=6 THEN 3 WHEN formality>=4 THEN 2 ELSE 1 END AS pf, tg, tc, CASE WHEN pc THEN 'frequent' ELSE 'rare' END AS pk, CASE WHEN directness>=7 THEN 'short' ELSE 'medium' END AS ps, CASE WHEN warmth>=7 THEN 'question' ELSE 'statement' END AS ph FROM fl),
      z AS (SELECT an.id, p.persona_id, len(tone)>0 AND len(pt)>0 AS a, len(list_intersect(tone,pt))/greatest(len(list_distinct(list_concat(tone,pt))),1) AS av, 1-abs(CASE formality WHEN 'formal' THEN 4 WHEN 'semi-formal' THEN 3 ELSE 1 END-pf)/3 AS bv,
       greeting<>'' AND tg<>'' AS g, {_SIM('greeting','tg')} AS gv, closing<>'' AND tc<>'' AS c, {_SIM('closing','tc')} AS cv, contractions=pk AS kv, sentence=ps AS sv, hook=ph AS hv FROM an CROSS JOIN p),
      w AS (SELECT id, persona_id, round((CASE WHEN a THEN av*0.25 ELSE 0 END + bv*0.2 + CASE WHEN g THEN gv::INT*0.15 ELSE 0 END + CASE WHEN c THEN cv::INT*0.15 ELSE 0 END + kv::INT*0.1 + sv::INT*0.1 + hv::INT*0.15)::DOUBLE/(CASE WHEN a THEN 0.25 ELSE 0 END+0.2+CASE WHEN g THEN 0.15 ELSE 0 END+CASE WHEN c THEN 0.15 ELSE 0 END+0.1+0.1+0.15)::DOUBLE, 6) AS score FROM z),
      k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, persona_id) AS k FROM w) SELECT id, CASE WHEN score>=0.4 THEN persona_id END AS persona_id, score, CASE WHEN score>=0.7 THEN 'assigned' WHEN score>=0.4 THEN 'flagged' ELSE 'unassigned' END AS status FROM k WHERE k=1""",
    "grp_traits": f"WITH {_TRAITS} SELECT tr.* FROM tr",
    "grp_rules": f"""WITH {_TRAITS} SELECT * FROM (SELECT persona_id, unnest(list_filter(['Open with: ' || greeting, 'Sign off with: ' || closing, CASE WHEN tone<>'' THEN 'Maintain ' || replace(tone, ',', ', ') || ' tone' END, 'Keep ' || formality || ' register',
      CASE contractions WHEN 'frequent' THEN 'Use contractions freely' WHEN 'rare' THEN 'Avoid contractions' END], lambda x: x IS NOT NULL)) AS rule FROM tr)""",
    "grp_merge": """WITH t AS (SELECT *, CASE persona_id WHEN 'per_02' THEN 'per_01' WHEN 'per_04' THEN 'per_03' ELSE persona_id END AS t FROM personas)
      SELECT t AS persona_id, max(persona_name) FILTER (persona_id = t) AS persona_name, round_even(avg(characteristics.formality), 0)::INT AS formality, round_even(avg(characteristics.warmth), 0)::INT AS warmth, round_even(avg(characteristics.authority), 0)::INT AS authority,
       round_even(avg(characteristics.directness), 0)::INT AS directness, count(*) AS merged FROM t GROUP BY 1""",
    "sta_upsert": """WITH o AS (SELECT persona_id AS name, 'old' AS d, DATE '2024-01-01' AS c FROM personas WHERE persona_id <= 'per_05'), n AS (SELECT persona_id AS name, description AS d, DATE '2024-06-01' AS u FROM personas WHERE persona_id > 'per_01'),
      k AS (SELECT persona_id AS name, count(DISTINCT id) AS n FROM samples WHERE persona_id IS NOT NULL GROUP BY 1) SELECT name, coalesce(n.d, o.d) AS description, coalesce(o.c, n.u) AS created, coalesce(n.u, o.c) AS updated, coalesce(k.n, 0) AS sample_count
      FROM o FULL JOIN n USING (name) LEFT JOIN k USING (name)""",
    "sta_new_samples": """WITH c AS (SELECT lower(trim(source)) AS source, lower(content_hash) AS content_hash, created_at FROM samples WHERE content_hash IS NOT NULL),
      f AS (SELECT content_hash, min(source) AS source FROM c WHERE content_hash NOT IN (SELECT content_hash FROM c WHERE created_at < TIMESTAMP '2023-07-01') GROUP BY 1)
      SELECT source, content_hash, row_number() OVER (PARTITION BY source ORDER BY content_hash) AS seq FROM f""",
    "grp_feedback": """WITH r AS (SELECT user_id AS persona, count(*) FILTER (event_type='purchase') AS pos, count(*) FILTER (event_type='error') AS neg FROM events WHERE event_type IN ('purchase','error') GROUP BY 1)
      SELECT persona, pos, neg, CASE WHEN neg > pos THEN 'needs_refinement' WHEN pos >= 3 AND neg = 0 THEN 'well_calibrated' ELSE 'mixed' END AS status, round(greatest(pos, neg)/(pos+neg), 6) AS confidence FROM r""",
    "set_missing": """WITH n AS (SELECT DISTINCT persona_id FROM samples WHERE persona_id IS NOT NULL AND persona_id <> 'per_03'), k AS (SELECT persona_id FROM personas WHERE characteristics.typical_greeting IS NOT NULL)
      SELECT persona_id, 'unknown' AS side FROM n WHERE persona_id NOT IN (SELECT persona_id FROM k) UNION ALL SELECT persona_id, 'unused' FROM k WHERE persona_id NOT IN (SELECT persona_id FROM n)""",
    "sta_export": """SELECT coalesce(persona_id, 'unassigned') AS persona_id, regexp_replace(lower(trim(source)), '[ -]', '_', 'g') AS source, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM samples ORDER BY id) GROUP BY 1, 2""",
}
