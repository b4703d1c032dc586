"""Queries on social posts.

The documents that are posts serve as posts, each author being a group; likes, comments and
addresses are made from the document's number, alike in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import mail, posts
from scriptorium.tables import spread, table


def _posts(spark, directory):
    d = spread(table(spark, directory, "documents"))
    source = F.regexp_replace(F.lower(F.trim("source")), "-", "_")
    rows = d.where(source == "linkedin_post")
    number = F.col("doc_id")
    return rows.select(
        F.coalesce("author_id", F.lit("none")).alias("group"), number.alias("post_id"), "text", (number * 37 % 501).alias("likes"), (number * 13 % 41).alias("comments"),
        F.concat(F.lit("HTTP://posts.example/"), F.coalesce("author_id", F.lit("none")), F.lit("/"), (number % 97).cast("string"), F.lit("/?t="), number.cast("string")).alias("url"),
        F.concat(F.lit("acc_"), F.lpad((number % 50).cast("string"), 4, "0")).alias("user_id"),
    )


def _query(function):
    return lambda spark, directory: function(_posts(spark, directory))


def flt_posts(spark, directory):
    """Each post with the reason that rejects it, its weight and whether it is its author's own."""
    p = _posts(spark, directory)
    return p.select(
        "post_id", posts.post_quality(F.col("text")).alias("reason"), F.round(posts.weight(F.col("likes"), F.col("comments")), 6).alias("weight"),
        posts.owned(F.col("user_id"), F.col("url"), F.col("group"), F.col("group")).alias("own"), posts.url_key(F.col("url")).alias("url_key"),
    )


def set_urls(spark, directory):
    """The addresses of posts from two lists, once each, the first list first."""
    p = _posts(spark, directory)
    return posts.first_union(p.where("post_id % 3 = 0"), p, "url")


def _best(spark, directory):
    return posts.best_post(_posts(spark, directory)).select("group", "post_id", F.md5("text").alias("text_md5"))


def _count(spark, directory):
    """What each author's posts are good for."""
    rows = _posts(spark, directory).groupBy("group").agg(F.count("*").alias("n"))
    return rows.withColumn("quality", posts.sample_quality(F.col("n")))


def _owned(spark, directory):
    """Posts that are their author's by any sign."""
    n = F.col("post_id")
    rows = _posts(spark, directory).withColumn("author_url", F.when(n % 5 == 0, F.concat(F.lit("https://x.example/in/"), "group"))).withColumn("author", F.when(n % 7 == 0, F.lit("No One")))
    own = posts.ownership({c: F.col(c) for c in ("user_id", "author_url", "author")} | {"url": F.when(n % 3 == 0, F.col("url"))}, {"username": F.col("group"), "name": F.lit("No One")})
    return rows.where(own).select("post_id")


def _record(spark, directory):
    """Posts as whole records."""
    rows = posts.record(_posts(spark, directory).withColumn("tagged_people", F.when(F.col("post_id") % 2 == 0, F.array(F.lit("a")))).withColumn("likes", F.when(F.col("post_id") % 3 > 0, F.col("likes"))))
    return rows.select(F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "url", "likes", "comments", F.size("tagged_people").alias("people"), F.size("images").alias("images"), "is_repost", "author_followers")


QUERIES = {
    "flt_posts": flt_posts, "set_urls": set_urls, "post_tone": _query(posts.tone), "post_structure": _query(posts.structure), "post_keywords": _query(posts.keywords),
    "post_top_words": _query(posts.top_words), "post_linguistic": _query(posts.linguistic), "post_emoji": _query(posts.emoji), "post_platform": _query(posts.platform),
    "post_persona": _query(posts.persona), "post_formatting": _query(posts.formatting), "post_variation": _query(posts.variation), "post_best": _best, "post_totals": _query(posts.batch_totals),
    "cls_post_count": _count, "join_owned": _owned, "prj_record": _record,
}

_S = r"regexp_replace({}, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')"
_STRIP = lambda x: _S.format(x)
_P = """p AS (SELECT coalesce(author_id, 'none') AS "group", doc_id AS post_id, text, replace(coalesce(text,''), chr(13), '') AS t, doc_id*37%501 AS likes, doc_id*13%41 AS comments,
  greatest(1.0, ln(1 + doc_id*37%501 + 2*(doc_id*13%41))) AS w, 'HTTP://posts.example/' || coalesce(author_id,'none') || '/' || (doc_id%97) || '/?t=' || doc_id AS url,
  'acc_' || lpad((doc_id%50)::VARCHAR, 4, '0') AS user_id FROM documents WHERE replace(lower(trim(source)), '-', '_') = 'linkedin_post')"""
_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(url), '^http://', 'https://'), '/+$', ''), '\?.*$', '')"
_TECH = " + ".join(f"(length(lower(t)) - length(replace(lower(t), '{x}', ''))) / {len(x)}" for x in posts.TECH)
_TONE = rf"""
ts AS (SELECT "group", sum(length(t)*w)/sum(w) AS len, sum(len(regexp_extract_all(t, '{posts.SMILEYS}'))*w)/sum(w) AS emo, sum(contains(t,'?')::INT*w)/sum(w) AS que, avg({_TECH}) AS tech FROM p GROUP BY 1),
tone AS (SELECT "group", greatest(1, least(10, 7 - CASE WHEN emo > 2 THEN 2 ELSE 0 END - CASE WHEN len < 200 THEN 1 ELSE 0 END + CASE WHEN len > 1000 THEN 1 ELSE 0 END))::INT AS formality,
 (5 + CASE WHEN emo > 0.5 THEN 2 ELSE 0 END + CASE WHEN que > 0.3 THEN 1 ELSE 0 END)::INT AS warmth, (6 + CASE WHEN tech > 2 THEN 2 ELSE 0 END + CASE WHEN len > 800 THEN 1 ELSE 0 END)::INT AS authority,
 7 AS directness, round(len, 4) AS weighted_length FROM ts)"""
_WORDS = r"""wd AS (SELECT "group", unnest(regexp_extract_all(lower(t), '[\p{L}\p{N}_]+')) AS word FROM p), wc AS (SELECT "group", word, count(*) AS n FROM wd WHERE length(word) >= 4 GROUP BY ALL),
wr AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY n DESC, word) AS k FROM wc)"""
_PLAIN = "|".join(c for c in mail.CONTRACTIONS if c != "let's").replace("'", "''")

ORACLES = {
    "flt_posts": f"""WITH {_P}, z AS (SELECT *, coalesce(text,'') AS x, {_STRIP("coalesce(text,'')")} AS b FROM p) SELECT post_id, CASE WHEN length(x) < 200 THEN 'too_short' WHEN (ends_with(b, '... [Read more]') OR ends_with(b, 'See more')) AND length(x) < 500 THEN 'truncated'
      WHEN starts_with(x, 'Reposted') AND length(x) < 300 THEN 'repost' ELSE '' END AS reason, round(w, 6) AS weight, user_id = "group" AND contains(url, "group") AS own, {_KEY} AS url_key FROM z""",
    "set_urls": f"""WITH {_P}, u AS (SELECT url, 0 AS o FROM p WHERE post_id % 3 = 0 UNION ALL SELECT url, 1 FROM p), k AS (SELECT *, {_KEY} AS key FROM u),
      r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o, url) AS n FROM k) SELECT key, url, o AS source FROM r WHERE n = 1""",
    "post_tone": f"WITH {_P}, {_TONE} SELECT * FROM tone",
    "post_structure": f"""WITH {_P} SELECT "group", bool_or(regexp_matches(left(string_split(t, chr(10))[1], 50), '[?!]')) AS has_hook, bool_or(contains(left(string_split({_STRIP('t')}, chr(10))[-1], 50), '?')) AS has_call,
      bool_or(regexp_matches(t, '[•-]')) AS has_bullets, bool_or(contains(t, '#')) AS has_hashtags FROM p GROUP BY 1""",
    "post_keywords": f"""WITH {_P}, {_WORDS} SELECT "group", word, n FROM wr WHERE k <= 20 AND word IN ({', '.join(repr(w) for w in posts.DOMAIN)})""",
    "post_top_words": f"""WITH {_P}, {_WORDS} SELECT "group", k AS rank, word, n FROM wr WHERE k <= 5""",
    "post_linguistic": rf"""WITH {_P}, s AS (SELECT *, list_transform(list_filter(list_transform(string_split_regex(t, '[.!?]+'), lambda x: {_STRIP('x')}), lambda x: x <> ''), lambda x: len(string_split_regex(x, '[ \t\n\f\r]+'))) AS s FROM p)
      SELECT "group", coalesce(round(sum(coalesce(list_sum(s), 0)) / nullif(sum(len(s)), 0), 1), 0) AS sentence_length_avg_words, coalesce(round(sum(len(list_filter(s, lambda x: x < 8))) / nullif(sum(len(s)), 0), 2), 0) AS short_punchy_ratio,
      bool_or(regexp_matches(t, '(?i)\b(?:{_PLAIN})\b')) AS uses_contractions, bool_or(regexp_matches(t, '—|--')) AS uses_em_dash, bool_or(contains(t, '(') AND contains(t, ')')) AS uses_parentheticals,
      round(avg(length(t) - length(replace(t, '!', ''))), 1) AS exclamations_per_post, round(avg(length(t) - length(replace(t, '?', ''))), 1) AS questions_per_post FROM s GROUP BY 1""",
    "post_emoji": rf"""WITH {_P}, e AS (SELECT *, regexp_extract_all(t, '{posts.EMOJI}') AS e, string_split_regex(t, '{posts.EMOJI}+') AS pp, regexp_extract_all(t, '{posts.EMOJI}+') AS rr FROM p),
      r AS (SELECT "group", min(len(e)) AS min_emoji, max(len(e)) AS max_emoji FROM e GROUP BY 1), x AS (SELECT "group", unnest(e) AS e FROM e),
      k AS (SELECT "group", e, row_number() OVER (PARTITION BY "group" ORDER BY count(*) DESC, e) AS k FROM x GROUP BY 1, 2), tp AS (SELECT "group", string_agg(e, '' ORDER BY k) AS se FROM k WHERE k <= 5 GROUP BY 1),
      st AS (SELECT "group", length(t) AS n, unnest(list_transform(range(1, len(rr) + 1), lambda i: list_sum(list_transform(pp[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(rr[1:i-1], lambda y: length(y))), 0))) AS pos FROM e WHERE len(rr) > 0),
      pl AS (SELECT "group", CASE WHEN pos < n*0.2 THEN 'beginning' WHEN pos > n*0.8 THEN 'end' ELSE 'middle' END AS place, count(*) AS c FROM st GROUP BY ALL),
      b AS (SELECT "group", CASE WHEN max(c) < sum(c)*0.5 THEN 'emphasis_points' ELSE first(place ORDER BY c DESC, place) END AS placement FROM pl GROUP BY 1)
      SELECT r."group", min_emoji, max_emoji, coalesce(se, '') AS signature_emojis, coalesce(placement, 'none') AS placement FROM r LEFT JOIN tp USING ("group") LEFT JOIN b USING ("group")""",
    "post_platform": rf"""WITH {_P}, a AS (SELECT *, length(t) AS n, CASE WHEN length(t) > 0 THEN ((length(t) - length(replace(t, chr(10)||chr(10), ''))) / 2)::INT / (length(t)/100) ELSE 0 END AS br, regexp_matches(t, '(?m)^\s*[•*-]') AS bul,
       len(regexp_extract_all(t, '#[\p{{L}}\p{{N}}_]+')) AS tags, length(t) - strpos(reverse(t), '#') AS lt, list_filter(list_transform(string_split(t, chr(10)||chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '') AS ps,
       {_STRIP("string_split_regex(t, '[.!?\\n]')[1]")} AS fs, string_split({_STRIP('t')}, chr(10))[-1] AS en, CASE WHEN regexp_matches(t, 'https?://\S') THEN length(regexp_extract(t, '(?s)^(.*?)https?://\S', 1)) END AS lk FROM p),
      b AS (SELECT *, len(list_filter(ps, lambda x: len(regexp_extract_all(x, '[.!?]+')) <= 1)) AS sg, tags > 0 AND lt > n*0.8 AS te, regexp_matches(lower(fs), '{"|".join(posts.CALLS)}') AS ca, contains(en, '?') OR regexp_matches(lower(en), '{"|".join(posts.ASKS)}') AS ask,
       CASE WHEN lk < n*0.33 THEN 'beginning' WHEN lk < n*0.66 THEN 'middle' WHEN lk IS NOT NULL THEN 'end' END AS pl FROM a)
      SELECT "group", CASE WHEN avg(br) > 1.5 THEN 'high' WHEN avg(br) > 0.5 THEN 'medium' ELSE 'low' END AS line_break_frequency, coalesce(sum(sg)/nullif(sum(len(ps)),0), 0) > 0.5 AS single_sentence_paragraphs, bool_or(bul) AS uses_bullets, bool_or(tags>0) AS uses_hashtags,
       coalesce(min(CASE WHEN tags>0 THEN tags END), 0) AS min_tags, max(tags) AS max_tags, CASE WHEN count(*) FILTER (te) > count(*)*0.5 THEN 'end' ELSE 'inline' END AS hashtag_placement,
       CASE WHEN count(*) FILTER (ca) >= count(*) FILTER (NOT ca) THEN 'call_to_action' ELSE 'observation' END AS primary_hook, CASE WHEN count(*) FILTER (ask) > count(*)*0.3 THEN 'invitation' ELSE 'statement' END AS closing_style,
       round(count(*) FILTER (ask)/count(*), 2) AS engagement_ask_frequency, CASE WHEN count(pl)=0 THEN 'none' WHEN count(*) FILTER (pl='beginning') >= greatest(count(*) FILTER (pl='end'), count(*) FILTER (pl='middle')) THEN 'beginning'
       WHEN count(*) FILTER (pl='end') >= count(*) FILTER (pl='middle') THEN 'end' ELSE 'middle' END AS link_placement,
       trunc(quantile_cont(n, 0.1))::INT AS min_chars, trunc(quantile_cont(n, 0.5))::INT AS target_chars, trunc(quantile_cont(n, 0.9))::INT AS max_chars FROM b GROUP BY 1""",
    "post_persona": rf"""WITH {_P}, {_TONE}, e AS (SELECT *, len(regexp_extract_all(t, '{posts.EMOJI}')) AS em FROM p),
      s AS (SELECT "group", count(*) AS posts, CASE WHEN count(*)<3 THEN 0.3 WHEN count(*)<5 THEN 0.5 WHEN count(*)<10 THEN 0.6 WHEN count(*)<15 THEN 0.7 WHEN count(*)<20 THEN 0.8 WHEN count(*)<30 THEN 0.9 ELSE 0.95 END::DOUBLE AS confidence,
       greatest(1, least(10, trunc(5 + (2*avg(length(t)-length(replace(t,'!',''))) + avg(length(t)-length(replace(t,'?',''))) + (min(em)+max(em))/2)/2)::INT)) AS enthusiasm, round(avg(w), 6) AS mean_weight FROM e GROUP BY 1),
      k AS (SELECT "group", post_id, row_number() OVER (PARTITION BY "group" ORDER BY likes DESC, length(t) DESC, post_id) AS k FROM p), b AS (SELECT "group", string_agg(post_id::VARCHAR, ',' ORDER BY k) AS examples FROM k WHERE k <= 3 GROUP BY 1)
      SELECT "group", formality, warmth, authority, directness, posts, confidence, enthusiasm, mean_weight, examples FROM tone JOIN s USING ("group") JOIN b USING ("group")""",
    "post_formatting": rf"""WITH {_P}, e AS (SELECT *, len(regexp_extract_all(t, '{posts.EMOJI}')) AS em FROM p) SELECT "group", bool_or(regexp_matches(t, '[•-]')) AS uses_bullets, bool_or(contains(t, '#')) AS uses_hashtags,
      CASE WHEN sum(em) = 0 THEN 'none' WHEN sum(em) >= count(*) THEN 'frequent' WHEN sum(em)*2 >= count(*) THEN 'moderate' ELSE 'rare' END AS emoji_frequency FROM e GROUP BY 1""",
    "post_variation": rf"""WITH {_P}, e AS (SELECT *, len(regexp_extract_all(t, '{posts.EMOJI}')) AS em, len(list_filter(list_transform(string_split_regex(t, '[.!?]+'), lambda x: {_STRIP('x')}), lambda x: x <> '')) AS sn, length(t) - length(replace(t, '?', '')) AS qs,
       {_STRIP("string_split_regex(t, '[.!\n]')[1]")} AS op FROM p), h AS (SELECT *, CASE WHEN sn > 0 THEN qs/sn ELSE 0 END AS q, CASE WHEN contains(op, '?') THEN 'q' WHEN regexp_matches(lower(op), '{"|".join(posts.CALLS)}') THEN 'c' ELSE 'o' END AS h FROM e)
      SELECT "group", min(em) AS min_emoji, max(em) AS max_emoji, round(min(q), 2) AS min_questions, round(max(q), 2) AS max_questions, round(count(*) FILTER (h='q')/count(*), 2) AS question, round(count(*) FILTER (h='c')/count(*), 2) AS call_to_action,
       round(count(*) FILTER (h='o')/count(*), 2) AS observation FROM h GROUP BY 1""",
    "post_best": f"""WITH {_P}, k AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY likes DESC, length(t) DESC, post_id) AS k FROM p) SELECT "group", post_id, md5(t) AS text_md5 FROM k WHERE k = 1""",
    "post_totals": f"WITH {_P} SELECT count(*) AS posts, sum(likes)::BIGINT AS likes, sum(comments)::BIGINT AS comments, 0 AS held FROM p",
    "cls_post_count": f"""WITH {_P} SELECT "group", count(*) AS n, CASE WHEN count(*) < 5 THEN 'insufficient' WHEN count(*) < 10 THEN 'minimal' WHEN count(*) < 15 THEN 'fair' WHEN count(*) < 20 THEN 'good' ELSE 'excellent' END AS quality FROM p GROUP BY 1""",
    "join_owned": f"""WITH {_P} SELECT post_id FROM p WHERE user_id = lower("group") OR (post_id % 3 = 0 AND contains(lower(url), lower("group"))) OR post_id % 5 = 0 OR post_id % 7 = 0""",
    "prj_record": f"""WITH {_P} SELECT md5(coalesce(text, '')) AS text_md5, url, CASE WHEN post_id % 3 > 0 THEN likes ELSE 0 END AS likes, comments, CASE WHEN post_id % 2 = 0 THEN 1 ELSE 0 END AS people, 0 AS images, false AS is_repost, 0 AS author_followers FROM p""",
}
