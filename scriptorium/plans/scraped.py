"""Queries on scraped text and on rendered texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import profiles, render, scraped, style
from scriptorium.plans.posts import _posts
from scriptorium.plans.style import ORACLES as ORACLES_OF_STYLE
from scriptorium.tables import table


def _pages(spark, directory):
    """Posts as scraped pages: furniture, reactions and comments around the text."""
    p = _posts(spark, directory)
    n = F.col("post_id")
    content = F.concat(
        F.lit("Sign in  Join for free\n"), F.coalesce("text", F.lit("")), F.lit("\n"), F.when(n % 2 == 0, F.concat(F.lit("["), F.col("likes").cast("string"), F.lit("]"))).otherwise(F.concat(F.col("likes").cast("string"), F.lit(" Reactions"))),
        F.lit("  "), F.col("comments").cast("string"), F.lit(" Comments Report this post"),
    )
    return p.select("post_id", "group", content.alias("content"), F.concat(F.lit("https://www.linkedin.com/posts/x_activity-"), n.cast("string"), F.lit("-ab?u=1")).alias("page"))


def prj_scraped(spark, directory):
    likes, comments = scraped.engagement(F.col("content"))
    p = _pages(spark, directory)
    text = scraped.clean(F.col("content"))
    return p.select("post_id", scraped.activity(F.col("page")).alias("activity"), F.md5(text).alias("text_md5"), likes.alias("likes"), comments.alias("comments"), F.size(scraped.hashtags(text)).alias("hashtags"))


def prj_keywords(spark, directory):
    """Keywords and search texts from each profile's name and description."""
    p = table(spark, directory, "personas")
    words = scraped.keywords(F.col("persona_name"), F.lit("Unknown"), F.col("description"))
    return p.select("persona_id", F.array_join(words, ",").alias("keywords"), F.array_join(scraped.queries("posts.example", F.col("persona_name"), F.slice(words, 1, 2), 2025), " ; ").alias("queries"))


def prj_urls(spark, directory):
    """Addresses: the profile's own form, its user name, and whether an article is the author's."""
    p = _posts(spark, directory).select("post_id", F.concat(F.lit("www.linkedin.com/in/"), "group", F.lit("/")).alias("raw"), "group", "url")
    from scriptorium.operators import posts

    full = posts.profile_url(F.col("raw"))
    return p.select("post_id", full.alias("profile"), scraped.username(full).alias("username"), scraped.article_is(F.col("url"), F.lit("No One"), F.col("group")).alias("own_article"))


def gen_posts(spark, directory):
    p = _posts(spark, directory)
    return p.select("post_id", F.md5(render.post_markdown(F.col("text"), F.col("likes"), F.col("comments"), F.lit(None).cast("timestamp"), F.col("post_id") - 1, F.lit(10))).alias("markdown_md5"))


def gen_replies(spark, directory):
    """Each pair's reply by each profile with a full set of scores."""
    p = table(spark, directory, "personas").where("characteristics is not null")
    v = table(spark, directory, "validation_pairs").select("id", F.col("context.subject").alias("s"), F.col("context.quoted_text").alias("q")).dropDuplicates(["id"])
    c = lambda k: F.coalesce(F.col(f"characteristics.{k}"), F.lit(5))
    parts = {k: c(k) for k in profiles.SCORES} | {k: F.coalesce(F.col(f"characteristics.{k}"), F.lit("")) for k in ("typical_greeting", "typical_closing")}
    parts["contractions"] = F.coalesce(F.col("characteristics.uses_contractions"), F.lit(True))
    rows = v.crossJoin(profiles.few(p)).select("id", "persona_id", render.reply(parts, F.col("s"), F.col("q")).alias("reply"))
    return rows.groupBy("persona_id", "reply").agg(F.count("*").alias("n"))


def gen_batches(spark, directory):
    """All mails of each account in batches of thirty, with their whole texts."""
    return render.batch_text(table(spark, directory, "email"), "account_id", "id", ["subject", "body"]).select("account_id", "batch", "n", F.md5("text").alias("text_md5"))


def gen_unread(spark, directory):
    """The first thirty mails that were not analysed."""
    read = table(spark, directory, "samples").where("email_id is not null").select(F.col("email_id").alias("id"))
    return render.first_unread(table(spark, directory, "email").select("id"), "id", read)


def gen_prompts(spark, directory):
    """A prompt for each batch of each account, with what was measured."""
    email = table(spark, directory, "email")
    rows = render.batch_text(email, "account_id", "id", ["subject", "body"])
    rate = style.formatting(email, "account_id").select("account_id", F.concat(F.lit("bullets "), F.col("uses_bullets_rate").cast("string")).alias("measured"))
    prompt = render.group_prompt(F.col("n"), F.lit(None).cast("string"), F.lit("Scores go from 1 to 10."), F.col("measured"), F.col("text"))
    return rows.join(rate, "account_id").select("account_id", "batch", F.length(prompt).alias("length"), F.md5(F.regexp_replace(prompt, r"bullets [0-9.E-]+", "bullets")).alias("prompt_md5"))


def _profiles(spark, directory):
    c = lambda k: F.col(f"characteristics.{k}")
    p = {"name": F.col("persona_name"), "description": F.col("description")} | {k: c(k) for k in ("formality", "warmth", "authority", "directness", "typical_greeting", "typical_closing")}
    return table(spark, directory, "personas").select("persona_id", render.profile_markdown(p).alias("section"))


def gen_profiles(spark, directory):
    """Each profile as a section."""
    return _profiles(spark, directory).select("persona_id", F.md5("section").alias("section_md5"))


def gen_document(spark, directory):
    """All profiles as one document."""
    return render.document(_profiles(spark, directory), "persona_id", "section", "Profiles").select(F.md5("text").alias("text_md5"), F.length("text").alias("n"))


def prj_facts(spark, directory):
    """Followers, connections and the about text of pages."""
    n = F.col("post_id")
    page = F.concat(F.lit("Name\n"), F.format_string("%,d", n * 37), F.lit(" followers  "), F.when(n % 2 == 0, F.lit("500+ connections")).otherwise(F.lit("")), F.lit("\nAbout\n"), F.when(n % 3 > 0, F.lit("Writes mails.")).otherwise(F.lit("")), F.lit("\n\nMore"))
    return _posts(spark, directory).select("post_id", scraped.profile_facts(page).alias("f")).select("post_id", "f.followers", "f.connections", "f.about")


def prj_searches(spark, directory):
    """Search words of each supplier as a profile."""
    s = table(spark, directory, "supplier")
    k = F.col("s_suppkey")
    title = F.when(k % 3 == 0, F.lit("Founder and CEO")).when(k % 3 == 1, F.lit("Engineering Manager"))
    past = F.array(F.lit("Acme"), F.lit("IO"), F.lit("Globex"), F.lit("Initech"))
    return s.select("s_suppkey", F.array_join(scraped.smart_queries(F.col("s_name"), title, F.when(k % 2 == 0, past), F.lit("software")), ",").alias("queries"))


def set_searches(spark, directory):
    """Addresses found by searches of several engines and by the feed, united, the first five of each author in rank order."""
    p = _posts(spark, directory)
    n = F.col("post_id")
    link = F.concat(F.lit("https://www.linkedin.com/posts/"), "group", F.lit("_activity-"), (n % 50).cast("string"), F.when(n % 2 == 0, F.lit("/?utm=1")).otherwise(F.lit("")))
    engines = [p.select("group", F.when(n % 4 == i, F.lit("")).otherwise(link).alias("link"), F.concat(F.lit("https://other.example/"), n.cast("string")).alias("url"), (n * 10 + i).alias("rank")) for i in (0, 1)]
    found = scraped.search_results(engines[0].unionByName(engines[1]), "group")
    return scraped.own_urls(found.withColumn("username", F.col("group")), "group", "url", "username", "rank", 5)


QUERIES = {f.__name__: f for f in (prj_scraped, prj_keywords, prj_urls, gen_posts, gen_replies, gen_batches, gen_unread, gen_prompts, gen_profiles, gen_document, prj_facts, prj_searches, set_searches)}

_P = """p AS (SELECT coalesce(author_id, 'none') AS "group", doc_id AS post_id, coalesce(text,'') AS text, doc_id*37%501 AS likes, doc_id*13%41 AS comments,
  'HTTP://posts.example/' || coalesce(author_id,'none') || '/' || (doc_id%97) || '/?t=' || doc_id AS url FROM documents WHERE replace(lower(trim(source)), '-', '_') = 'linkedin_post')"""


def _clean(x: str) -> str:
    for phrase in scraped.FURNITURE:
        x = f"replace({x}, '{phrase}', '')"
    return rf"trim(regexp_replace({x}, '[ \t\n\f\r\x0B]+', ' ', 'g'))"


_STOP = ", ".join(f"'{w}'" for w in scraped.STOPWORDS)

_BATCH = """d AS (SELECT account_id, id, min('## ' || id || chr(10) || coalesce(subject,'') || chr(10) || coalesce(body,'')) AS b FROM email GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY id) AS k FROM d),
bt AS (SELECT account_id, ((k-1)//30)::INT AS batch, count(*) AS n, string_agg(b, chr(10) || chr(10) ORDER BY k) AS text FROM r GROUP BY 1, 2)"""
_SECTION = """sc AS (SELECT persona_id, concat_ws(chr(10), '## ' || coalesce(persona_name, 'Unnamed'), nullif(description, ''), '- formality: ' || characteristics.formality, '- warmth: ' || characteristics.warmth, '- authority: ' || characteristics.authority,
 '- directness: ' || characteristics.directness, '- typical greeting: ' || characteristics.typical_greeting, '- typical closing: ' || characteristics.typical_closing) AS s FROM personas)"""

ORACLES = {
    "prj_scraped": rf"""WITH {_P}, c AS (SELECT *, 'Sign in  Join for free' || chr(10) || text || chr(10) || CASE WHEN post_id%2=0 THEN '[' || likes || ']' ELSE likes || ' Reactions' END || '  ' || comments || ' Comments Report this post' AS c FROM p), t AS (SELECT *, {_clean('c')} AS t FROM c),
      n AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract(c, '\[(\d+)\]', 1), '') AS INT), 0) AS a, coalesce(TRY_CAST(nullif(regexp_extract(c, '(?i)(\d+)\s+reactions?', 1), '') AS INT), 0) AS b, coalesce(TRY_CAST(nullif(regexp_extract(c, '(?i)(\d+)\s+comments?', 1), '') AS INT), 0) AS cm FROM t)
      SELECT post_id, post_id::VARCHAR AS activity, md5(t) AS text_md5, CASE WHEN a > 0 THEN a ELSE b END AS likes, cm AS comments, len(regexp_extract_all(t, '#[\p{{L}}\p{{N}}_]+')) AS hashtags FROM n""",
    "prj_keywords": rf"""WITH w AS (SELECT persona_id, persona_name, list_filter(list_concat(regexp_extract_all(regexp_replace(persona_name, '(?i)[|@-]|\bat\b', ' ', 'g'), '\b[A-Za-z]{{3,}}\b'), regexp_extract_all(coalesce(description,''), '\b[A-Za-z]{{4,}}\b')), lambda x: lower(x) NOT IN ({_STOP})) AS w FROM personas),
      k AS (SELECT persona_id, persona_name, list_filter(list_transform(range(1, len(w)+1), lambda i: CASE WHEN list_position(list_transform(w, lambda y: lower(y)), lower(w[i])) = i THEN w[i] END), lambda x: x IS NOT NULL)[1:5] AS k FROM w)
      SELECT persona_id, array_to_string(k, ',') AS keywords, array_to_string(list_concat(list_transform([2025, 2024, 2023], lambda y: 'site:posts.example "' || persona_name || '" ' || y), list_transform(k[1:2], lambda y: 'site:posts.example "' || persona_name || '" ' || y)), ' ; ') AS queries FROM k""",
    "prj_urls": f"""WITH {_P} SELECT post_id, 'https://www.linkedin.com/in/' || "group" AS profile, "group" AS username, contains(lower(url), lower("group")) AS own_article FROM p""",
    "gen_posts": f"""WITH {_P} SELECT post_id, md5('### Post ' || post_id || ' of 10' || chr(10) || chr(10) || '**Engagement:** ' || likes || ' likes, ' || comments || ' comments' || chr(10) || '**Date:** Unknown' || chr(10) || chr(10) || '**Text:**' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || '---') AS markdown_md5 FROM p""",
    "gen_replies": """WITH f AS (SELECT persona_id, coalesce(characteristics.formality,5) AS f, coalesce(characteristics.warmth,5) AS w, coalesce(characteristics.authority,5) AS a, coalesce(characteristics.directness,5) >= 7 AS d, coalesce(characteristics.typical_greeting,'') AS g, coalesce(characteristics.typical_closing,'') AS c,
       coalesce(characteristics.uses_contractions,true) AS u FROM personas WHERE characteristics IS NOT NULL), v AS (SELECT DISTINCT ON (id) lower(coalesce(context.subject,'')) AS s, coalesce(context.quoted_text,'') AS q FROM validation_pairs),
      b AS (SELECT *, CASE WHEN contains(s,'update') THEN CASE WHEN d THEN 'Here''s the update:' ELSE 'I wanted to share an update on this.' END WHEN contains(s,'question') OR contains(q,'?') THEN CASE WHEN d THEN 'Quick answer:' WHEN w >= 6 THEN 'Happy to help with this.' ELSE 'Here''s what I can share:' END
       ELSE CASE WHEN d THEN 'Three things:' WHEN a >= 7 THEN 'Here''s my take:' ELSE 'Thanks for reaching out.' END END AS b FROM v CROSS JOIN f)
      SELECT persona_id, coalesce(nullif(g,''), CASE WHEN f>=7 THEN 'Good afternoon,' WHEN f>=5 THEN 'Hi,' ELSE 'Hey' END) || chr(10) || chr(10) || CASE WHEN u THEN b ELSE replace(replace(b, 'Here''s', 'Here is'), 'I''m', 'I am') END || chr(10) || chr(10) || coalesce(nullif(c,''), CASE WHEN f>=7 THEN 'Best regards,' WHEN f>=5 THEN 'Best,' ELSE 'Thanks' END) AS reply, count(*) AS n FROM b GROUP BY 1, 2""",
    "gen_batches": f"""WITH {_BATCH} SELECT account_id, batch, n, md5(text) AS text_md5 FROM bt""",
    "gen_unread": "SELECT DISTINCT id FROM email WHERE id NOT IN (SELECT email_id FROM samples WHERE email_id IS NOT NULL) ORDER BY id LIMIT 30",
    "gen_prompts": f"""WITH {_BATCH}, fm AS ({ORACLES_OF_STYLE['agg_formatting']}), x AS (SELECT account_id, batch, 'Describe the way of writing of these ' || n || ' mails.' || chr(10) || chr(10) || '# Calibration' || chr(10) || 'Scores go from 1 to 10.' || chr(10) || chr(10)
      || '# Measured' || chr(10) || 'bullets ' || uses_bullets_rate::DOUBLE || chr(10) || chr(10) || '# Mails' || chr(10) || text AS p FROM bt JOIN fm USING (account_id)) SELECT account_id, batch, length(p) AS length, md5(regexp_replace(p, 'bullets [0-9.E-]+', 'bullets', 'g')) AS prompt_md5 FROM x""",
    "gen_profiles": f"WITH {_SECTION} SELECT persona_id, md5(s) AS section_md5 FROM sc",
    "gen_document": f"WITH {_SECTION}, d AS (SELECT '# Profiles' || chr(10) || chr(10) || string_agg(s, chr(10) || chr(10) ORDER BY persona_id) AS t FROM sc) SELECT md5(t) AS text_md5, length(t) AS n FROM d",
    "prj_facts": f"""WITH {_P} SELECT post_id, (post_id*37)::INT AS followers, CASE WHEN post_id % 2 = 0 THEN 500 END AS connections, CASE WHEN post_id % 3 > 0 THEN 'Writes mails.' END AS about FROM p""",
    "prj_searches": """WITH s AS (SELECT s_suppkey, s_suppkey % 3 AS t, s_suppkey % 2 AS e, s_name FROM supplier) SELECT s_suppkey, array_to_string((list_concat(list_concat([trim(s_name)], CASE t WHEN 0 THEN ['CEO','founder'] WHEN 1 THEN ['manager','engineer'] ELSE [] END),
      list_concat(CASE WHEN e = 0 THEN ['Acme','Globex'] ELSE [] END, ['software'])))[1:6], ',') AS queries FROM s""",
    "set_searches": f"""WITH {_P}, e AS (SELECT *, 'https://www.linkedin.com/posts/' || "group" || '_activity-' || (post_id % 50) || CASE WHEN post_id % 2 = 0 THEN '/?utm=1' ELSE '' END AS link FROM p),
      r AS (SELECT "group", link AS url, post_id*10+i AS rank FROM e, (VALUES (0), (1)) v(i) WHERE post_id % 4 <> i), k AS (SELECT *, regexp_replace(regexp_replace(lower(url), '/+$', ''), '[?].*$', '') AS k FROM r),
      o AS (SELECT "group", k, min(struct_pack(rank := rank, url := url)) AS m FROM k GROUP BY 1, 2), q AS (SELECT "group", m.url AS url, row_number() OVER (PARTITION BY "group" ORDER BY m.rank, m.url)::INT AS place FROM o) SELECT * FROM q WHERE place <= 5""",
}
