"""Queries on groups of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import groups, mail
from scriptorium.tables import table


def ml_central(spark, directory):
    """The three vectors nearest to each label's mean."""
    return groups.central(table(spark, directory, "embeddings"), "label", "vec_id", "embedding")


def ml_kmeans(spark, directory):
    """Sizes of k-means groups with the number of groups found from the inertia."""
    return groups.kmeans(table(spark, directory, "embeddings"), "vec_id", "embedding").groupBy("cluster").agg(F.count("*").alias("n"))


def ml_density(spark, directory):
    """Dense groups of the vectors; -1 is outside."""
    return groups.density(table(spark, directory, "embeddings"), "vec_id", "embedding")


def _runs(spark, directory):
    return table(spark, directory, "clusters"), table(spark, directory, "samples")


def join_remaining(spark, directory):
    runs, samples = _runs(spark, directory)
    return groups.remaining(runs, samples, "email_id")


def grp_coverage(spark, directory):
    runs, samples = _runs(spark, directory)
    return groups.coverage(runs, samples, "email_id")


def grp_incomplete(spark, directory):
    """Groups that are begun but not complete."""
    return grp_coverage(spark, directory).where("analysed > 0 and not complete").select("run_id", "cluster", "analysed", "required")


def cls_health(spark, directory):
    return groups.health(_runs(spark, directory)[0])


def srt_chunks(spark, directory):
    return groups.chunks(_runs(spark, directory)[0], 20)


def srt_next(spark, directory):
    runs, samples = _runs(spark, directory)
    return groups.next_group(runs, samples, "email_id")


def ml_summary(spark, directory):
    """How recipient type, audience and thread position are spread over each run's groups."""
    return groups.summary(_runs(spark, directory)[0], mail.enrich(table(spark, directory, "email")), "id", ["recipient_type", "audience", "thread_position"])


def ml_alike(spark, directory):
    """Personas alike by the words of name and description."""
    p = table(spark, directory, "personas").select("persona_id", F.concat_ws(" ", "persona_name", "description").alias("text"))
    return groups.alike(p, "persona_id", "text", 0.1)


def join_samples(spark, directory):
    """Analysed samples with their mail's text length, 0 for a mail that is missing."""
    s = table(spark, directory, "samples").select("id", "email_id").distinct()
    e = table(spark, directory, "email").select(F.col("id").alias("email_id"), F.length(F.coalesce("body", F.lit(""))).alias("n")).distinct()
    return s.join(e, "email_id", "left").select("id", "email_id", F.coalesce("n", F.lit(0)).alias("body_length"))


def ml_overview(spark, directory):
    """The labels of the vectors as groups, label 0 standing for what is outside."""
    return groups.overview(table(spark, directory, "embeddings").select("vec_id", F.col("label").alias("cluster")), 0)


def ml_silhouette(spark, directory):
    """How well the labels part the vectors."""
    e = table(spark, directory, "embeddings")
    return spark.range(1).select(F.lit(round(groups.silhouette(e, "embedding", "label"), 6)).alias("silhouette"))


def cls_quality(spark, directory):
    """Warnings of runs with silhouettes, those being made from the run's number."""
    runs = _runs(spark, directory)[0]
    return groups.health(runs, runs.select("run_id", (F.col("run_id") % 5 / 10).alias("silhouette"))).select("run_id", "warnings")


def ml_vectors(spark, directory):
    """Labels whose mean vectors are alike."""
    e = table(spark, directory, "embeddings").select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("v"))
    return groups.alike_vectors(means, "label", "v", -0.2)


def ml_auto(spark, directory):
    """Sizes of the groups that the automatic choice of a method finds."""
    return groups.overview(groups.run(table(spark, directory, "embeddings"), "vec_id", "embedding"))


QUERIES = {
    f.__name__: f
    for f in (ml_central, ml_kmeans, ml_density, join_remaining, grp_coverage, grp_incomplete, cls_health, srt_chunks, srt_next, ml_summary, ml_alike, join_samples, ml_overview, ml_silhouette, cls_quality, ml_vectors, ml_auto)
}

_M = """c AS (SELECT run_id, unnest(clusters) AS c FROM clusters), m0 AS (SELECT run_id, c.id AS cluster, coalesce(c.is_noise, false) AS is_noise, c.sample_ids AS ids FROM c WHERE c.sample_ids IS NOT NULL),
m AS (SELECT run_id, cluster, is_noise, unnest(range(len(ids)))::INT AS position, unnest(ids) AS id FROM m0), a AS (SELECT DISTINCT email_id AS id FROM samples WHERE email_id IS NOT NULL),
cov AS (SELECT run_id, cluster, count(*) AS n, count(a.id) AS analysed FROM m LEFT JOIN a ON m.id = a.id WHERE NOT is_noise GROUP BY 1, 2),
cv AS (SELECT *, round(analysed/n, 6) AS coverage, floor(n*0.8+0.999)::BIGINT AS required, analysed >= floor(n*0.8+0.999) AS complete FROM cov)"""
_ADDR = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-zA-Z]{2,}"

ORACLES = {
    "ml_central": """WITH e AS (SELECT label, vec_id, embedding AS v, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, d, avg(x) AS m FROM e GROUP BY 1, 2),
      f AS (SELECT label, vec_id, round(sqrt(sum((x-m)*(x-m))), 6) AS distance FROM e JOIN m USING (label, d) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM f)
      SELECT label, rank, vec_id, distance FROM r WHERE rank <= 3""",
    "join_remaining": f"WITH {_M} SELECT run_id, cluster, position, id FROM m WHERE NOT is_noise AND id NOT IN (SELECT id FROM a)",
    "grp_coverage": f"WITH {_M} SELECT * FROM cv",
    "grp_incomplete": f"WITH {_M} SELECT run_id, cluster, analysed, required FROM cv WHERE analysed > 0 AND NOT complete",
    "cls_health": """WITH c AS (SELECT run_id, unnest(clusters) AS c FROM clusters), s AS (SELECT run_id, coalesce(c.is_noise, false) AS noise, coalesce(len(c.sample_ids), 0) AS n FROM c),
      r AS (SELECT run_id, count(*) FILTER (NOT noise) AS groups, coalesce(sum(n) FILTER (noise), 0) AS noise, sum(n) AS total FROM s GROUP BY 1), x AS (SELECT *, coalesce(noise/nullif(total,0), 0) AS sh FROM r)
      SELECT run_id, groups, noise::BIGINT AS noise, total::BIGINT AS total, round(sh, 6) AS noise_share, array_to_string(list_filter([CASE WHEN groups < 3 THEN 'few_groups' END, CASE WHEN groups > 10 THEN 'many_groups' END,
       CASE WHEN sh > 0.3 THEN 'high_noise' WHEN sh > 0.1 THEN 'moderate_noise' END], lambda v: v IS NOT NULL), ',') AS warnings FROM x""",
    "srt_chunks": f"WITH {_M} SELECT run_id, cluster, cluster || '_' || (position // 20) AS chunk, count(*) AS n FROM m WHERE NOT is_noise GROUP BY 1, 2, 3",
    "srt_next": f"""WITH {_M}, w AS (SELECT run_id, cluster, count(*) AS n FROM m GROUP BY 1, 2), l AS (SELECT run_id, cluster, count(*) AS "left" FROM m WHERE NOT is_noise AND id NOT IN (SELECT id FROM a) GROUP BY 1, 2),
      r AS (SELECT l.*, row_number() OVER (PARTITION BY l.run_id ORDER BY n DESC, l.cluster) AS k FROM l JOIN w USING (run_id, cluster)) SELECT run_id, cluster, "left" FROM r WHERE k = 1""",
    "ml_summary": rf"""WITH {_M}, e0 AS (SELECT id, list_distinct(regexp_extract_all(lower(coalesce(to_addr,'')), '{_ADDR}')) AS rs, split_part(regexp_extract(lower(coalesce(from_addr,'')), '{_ADDR}'), '@', 2) AS own,
       lower(trim(coalesce(subject,''))) AS sl FROM email), e1 AS (SELECT *, list_distinct(list_transform(rs, lambda x: split_part(x,'@',2))) AS ds FROM e0),
      e AS (SELECT DISTINCT id, CASE WHEN len(rs)=1 THEN 'individual' WHEN len(rs)<=5 THEN 'small_group' WHEN len(rs)<=15 THEN 'team' ELSE 'broadcast' END AS recipient_type,
       CASE WHEN len(ds)=0 THEN 'unknown' WHEN len(list_filter(ds, lambda x: x=own))=len(ds) THEN 'internal' WHEN NOT list_contains(ds, own) THEN 'external' ELSE 'mixed' END AS audience,
       CASE WHEN regexp_matches(sl,'^(fwd:|fw:)') THEN 'forward' WHEN starts_with(sl,'re:') THEN 'reply' ELSE 'initiating' END AS thread_position FROM e1), j AS (SELECT run_id, cluster, recipient_type, audience, thread_position FROM m JOIN e USING (id))
      SELECT run_id, cluster, dimension, value, count(*) AS n FROM (UNPIVOT j ON recipient_type, audience, thread_position INTO NAME dimension VALUE value) GROUP BY ALL""",
    "ml_alike": r"""WITH w AS (SELECT persona_id AS i, unnest(regexp_extract_all(lower(concat_ws(' ', persona_name, description)), '[\p{L}\p{N}_]+')) AS w FROM personas), c AS (SELECT i, w, count(*) AS n FROM w WHERE length(w) >= 4 GROUP BY 1, 2),
      z AS (SELECT i, sqrt(sum(n*n)) AS z FROM c GROUP BY 1), d AS (SELECT a.i AS id_a, b.i AS id_b, sum(a.n*b.n) AS d FROM c a JOIN c b ON a.w = b.w AND a.i < b.i GROUP BY 1, 2)
      SELECT id_a, id_b, round(d/(x.z*y.z), 6) AS cosine FROM d JOIN z x ON x.i = id_a JOIN z y ON y.i = id_b WHERE round(d/(x.z*y.z), 6) >= 0.1""",
    "join_samples": """SELECT id, s.email_id, coalesce(n, 0) AS body_length FROM (SELECT DISTINCT id, email_id FROM samples) s
      LEFT JOIN (SELECT DISTINCT id AS email_id, length(coalesce(body,'')) AS n FROM email) e ON s.email_id = e.email_id""",
    "ml_overview": """SELECT label AS cluster, count(*) AS size, label = 0 AS is_noise, row_number() OVER (ORDER BY label = 0, count(*) DESC, label)::INT AS place FROM embeddings GROUP BY label""",
    "ml_silhouette": """WITH e AS (SELECT vec_id AS i, label AS l, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT l, d, sum(x) AS s, sum(x*x) AS q, count(*) AS n FROM e GROUP BY 1, 2),
      t AS (SELECT e.i, e.l, s.l AS o, s.n, sum(e.x*e.x*s.n - 2*e.x*s.s + s.q) AS t FROM e JOIN s USING (d) GROUP BY 1, 2, 3, 4), a AS (SELECT i, max(t/greatest(n-1, 1)) FILTER (l = o) AS a, min(t/n) FILTER (l <> o) AS b, max(n) FILTER (l = o) AS n FROM t GROUP BY 1)
      SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b-a)/greatest(a, b) END), 6) AS silhouette FROM a""",
    "cls_quality": """WITH c AS (SELECT run_id, unnest(clusters) AS c FROM clusters), s AS (SELECT run_id, coalesce(c.is_noise, false) AS noise, coalesce(len(c.sample_ids), 0) AS n FROM c),
      r AS (SELECT run_id, count(*) FILTER (NOT noise) AS groups, coalesce(sum(n) FILTER (noise), 0) AS noise, sum(n) AS total FROM s GROUP BY 1), x AS (SELECT *, coalesce(noise/nullif(total,0), 0) AS sh FROM r)
      SELECT run_id, array_to_string(list_filter([CASE WHEN groups < 3 THEN 'few_groups' END, CASE WHEN groups > 10 THEN 'many_groups' END, CASE WHEN sh > 0.3 THEN 'high_noise' WHEN sh > 0.1 THEN 'moderate_noise' END,
       CASE WHEN run_id % 5 / 10 < 0.15 AND groups > 1 THEN 'low_silhouette' END], lambda v: v IS NOT NULL), ',') AS warnings FROM x""",
    "ml_vectors": """WITH e AS (SELECT label AS l, unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT l, d, avg(x) AS m FROM e GROUP BY 1, 2), z AS (SELECT l, sqrt(sum(m*m)) AS z FROM m GROUP BY 1),
      c AS (SELECT a.l AS id_a, b.l AS id_b, sum(a.m*b.m) AS p FROM m a JOIN m b ON a.d = b.d AND a.l < b.l GROUP BY 1, 2) SELECT id_a, id_b, round(p/(x.z*y.z), 6) AS cosine FROM c JOIN z x ON x.l = id_a JOIN z y ON y.l = id_b WHERE p/(x.z*y.z) >= -0.2""",
}
