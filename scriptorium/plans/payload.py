"""Queries on mail fields from the payload, vector texts and pairs of context and reply."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import mail, payload
from scriptorium.plans.mail import _ADDR, _STRIP
from scriptorium.plans.mail import ORACLES as ORACLES_OF_MAIL
from scriptorium.plans.nested_mail import _READ
from scriptorium.tables import spread, table


def _read(spark, directory):
    rows = spread(table(spark, directory, "email").where("payload is not null").select("id", "payload", "snippet").distinct())
    return rows.select("id", payload.fields(F.col("payload"), F.col("snippet")).alias("p"))


def prj_body(spark, directory):
    """Subject and decoded body of each readable payload."""
    return _read(spark, directory).where("p.readable").select("id", "p.subject", F.length("p.body").alias("body_length"), F.md5("p.body").alias("body_md5"))


def prj_headers(spark, directory):
    """Sender and recipients, copies included, of each readable payload."""
    p = _read(spark, directory).where("p.readable")
    return p.select("id", "p.sender", F.col("p.cc").alias("cc"), F.array_join("p.recipients", ",").alias("recipients"), F.size("p.recipients").alias("n"))


def cls_thread(spark, directory):
    """Thread position and depth by subject, references and reply header."""
    position, depth = payload.thread_position(F.col("p.subject"), F.col("p.refs"), F.col("p.in_reply_to"))
    return _read(spark, directory).where("p.readable").select("id", position.alias("thread_position"), depth.alias("thread_depth"))


def cls_attachment(spark, directory):
    """Parts with a file name, at any depth."""
    return _read(spark, directory).where("p.readable").select("id", F.col("p.attachments").alias("attachments"), (F.col("p.attachments") > 0).alias("has_attachments"))


def prj_enrichment(spark, directory):
    """The record of enrichment: recipients, audience, thread, attachments, time and structure of each mail."""
    rows = payload.with_fields(spread(table(spark, directory, "email")))
    position, depth = payload.thread_position(F.col("mail.subject"), F.col("mail.refs"), F.col("mail.in_reply_to"))
    part, day, weekend = mail.time_context(F.col("internal_date"))
    own = F.lower(F.split_part(F.coalesce(F.get(mail.addresses(F.col("mail.sender")), F.lit(0)), F.lit("")), F.lit("@"), F.lit(2)))
    domains = F.array_distinct(F.transform("mail.recipients", lambda a: F.lower(F.split_part(a, F.lit("@"), F.lit(2)))))
    rows = rows.withColumn("n", F.size("mail.recipients")).withColumn("body", F.col("mail.body"))
    rows = rows.select(
        "id", "body", "n", mail.recipient_type(F.col("n")).alias("recipient_type"), mail.audience(domains, own).alias("audience"), "mail.has_cc", position.alias("thread_position"),
        depth.alias("thread_depth"), (F.col("mail.attachments") > 0).alias("has_attachments"), part.alias("time_of_day"), day.alias("day_of_week"), weekend.alias("is_weekend"),
    )
    out = mail.structure(rows)
    return out.drop("body", "line_count", "avg_paragraph_length").withColumn("has_bullets", F.col("bullet_count") > 0).withColumnRenamed("n", "recipient_count").distinct()


def prj_vector_text(spark, directory):
    """The text of each mail for a vector model."""
    rows = spread(table(spark, directory, "email").select("id", "subject", "body"))
    text = payload.seek_text(F.col("subject"), F.col("body"))
    return rows.select("id", F.length(text).alias("n"), F.md5(text).alias("text_md5")).where("n >= 10")


def _pairs(spark, directory):
    rows = mail.split_reply(spread(table(spark, directory, "email").select("id", "body", "subject", "thread_id", "snippet").where("coalesce(body, '') <> ''")))
    rows = rows.withColumn("reply_text", F.coalesce(F.nullif("reply_text", F.lit("")), F.nullif("snippet", F.lit("")))).where("reply_text is not null")
    greeting, closing = payload.reply_ends(F.col("reply_text"))
    hints = mail.tone_hints(F.col("reply_text"))
    return rows.select(
        "id", F.coalesce("subject", F.lit("")).alias("subject"), F.col("thread_id"), "quoted_text", (F.col("quoted_text") != "").alias("has_context"), "reply_text", greeting.alias("greeting"),
        closing.alias("closing"), hints.alias("tone_hints"), F.size(F.filter(F.split("reply_text", r"[ \t\n\r\f\x0b]+", -1), lambda w: w != "")).alias("word_count"),
        F.array_contains(hints, "uses_contractions").alias("has_contractions"),
    )


def prj_pairs(spark, directory):
    """Each mail with a reply as a pair of what was quoted and what was answered."""
    p = _pairs(spark, directory)
    return p.select("id", "has_context", F.md5("reply_text").alias("reply_md5"), "greeting", "closing", F.array_join("tone_hints", ",").alias("tone_hints"), "word_count", "has_contractions")


def val_pairs(spark, directory):
    """How many pairs there are and what share has a context, greetings and contractions."""
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return _pairs(spark, directory).agg(
        F.count("*").alias("pairs"), share(F.col("has_context")).alias("with_context"), share(F.col("greeting") != "").alias("with_greeting"), share(F.col("has_contractions")).alias("with_contractions")
    )


QUERIES = {f.__name__: f for f in (prj_body, prj_headers, cls_thread, cls_attachment, prj_enrichment, prj_vector_text, prj_pairs, val_pairs)}

_SP = _STRIP.format
_OPENS = payload.REPLY_OPENS
_ENDS = payload.REPLY_ENDS
_FIELDS = (
    _READ
    + rf""", snip AS (SELECT DISTINCT id, snippet FROM email WHERE payload IS NOT NULL),
hd AS (SELECT id, i, lower(json_extract_string(h, '$.name')) AS name, json_extract_string(h, '$.value') AS value FROM (
  SELECT id, unnest(range(len(hs))) AS i, unnest(hs) AS h FROM (SELECT id, CASE json_type(node, '$.headers') WHEN 'ARRAY' THEN CAST(node->'$.headers' AS JSON[]) WHEN 'OBJECT' THEN [node->'$.headers'] END AS hs FROM nodes WHERE path = '') a WHERE hs IS NOT NULL) b
  WHERE json_type(h, '$.name') = 'VARCHAR' AND json_type(h, '$.value') = 'VARCHAR'),
h1 AS (SELECT id, name, first(value ORDER BY i) AS value FROM hd WHERE value <> '' GROUP BY 1, 2),
hs AS (SELECT id, max(value) FILTER (name = 'subject') AS subject, max(value) FILTER (name = 'from') AS sender, max(value) FILTER (name = 'cc') AS cc, max(value) FILTER (name = 'references') AS refs, max(value) FILTER (name = 'in-reply-to') AS irt FROM h1 GROUP BY 1),
rc AS (SELECT id, list_sort(list_distinct(flatten(list(regexp_extract_all(value, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[a-zA-Z]{{2,}}'))))) AS recipients FROM hd WHERE name IN ('to', 'cc', 'bcc') GROUP BY 1),
nd AS (SELECT id, path, list_transform(CASE WHEN path = '' THEN [] ELSE string_split(path, '.') END, lambda x: x::INT) AS ord, json_extract_string(node, '$.mimeType') AS mime, json_extract_string(node, '$.filename') AS filename,
  CASE WHEN json_type(node, '$.body.data') = 'VARCHAR' THEN translate(json_extract_string(node, '$.body.data'), '-_', '+/') END AS d FROM nodes),
dc AS (SELECT *, try(decode(from_base64(d || repeat('=', ((4 - length(d) % 4) % 4)::INT)))) AS t FROM nd),
bd AS (SELECT id, first(t ORDER BY ord) FILTER (path <> '' AND mime = 'text/plain' AND t <> '') AS plain, max(t) FILTER (path = '' AND t <> '') AS own, count(*) FILTER (path <> '' AND filename <> '') AS att FROM dc GROUP BY 1),
f AS (SELECT bd.id, coalesce(plain, own, nullif(snippet, ''), '') AS body, coalesce(subject, '') AS subject, coalesce(sender, '') AS sender, coalesce(cc, '') AS cc, coalesce(recipients, []) AS recipients,
  len(list_filter(string_split_regex(coalesce(refs, ''), '\s+'), lambda x: x <> '')) AS refs, irt IS NOT NULL AS irt, att FROM bd JOIN snip USING (id) LEFT JOIN hs USING (id) LEFT JOIN rc USING (id))"""
)
_POSITION = rf"""CASE WHEN regexp_matches(lower({_SP('subject')}), '^(fwd:|fw:)') THEN 'forward' WHEN refs > 0 OR irt OR starts_with(lower({_SP('subject')}), 're:') THEN 'reply' ELSE 'initiating' END AS thread_position,
  CASE WHEN regexp_matches(lower({_SP('subject')}), '^(fwd:|fw:)') THEN 1 WHEN refs > 0 OR irt THEN greatest(refs, 1) WHEN starts_with(lower({_SP('subject')}), 're:') THEN 1 ELSE 0 END AS thread_depth"""

_SPLIT = ORACLES_OF_MAIL["prj_reply"].split("SELECT id, length(quoted)")[0]
_TONES = ORACLES_OF_MAIL["prj_reply"].split("AS reply_md5, ")[1].split(" AS tone_hints")[0]
_PAIRS = (
    _SPLIT
    + rf""", sn AS (SELECT row_number() OVER () AS rid, snippet, body FROM email), pr0 AS (SELECT id, quoted, coalesce(nullif(reply, ''), nullif(snippet, '')) AS reply FROM g JOIN sn USING (rid) WHERE coalesce(body, '') <> ''),
pr1 AS (SELECT *, {_TONES} AS tone_hints, list_filter(list_transform(string_split(replace(reply, chr(13), ''), chr(10)), lambda x: {_SP('x')}), lambda x: x <> '') AS ls FROM pr0 WHERE reply IS NOT NULL),
pr AS (SELECT id, quoted <> '' AS has_context, md5(reply) AS reply_md5, coalesce(CASE WHEN regexp_matches(ls[1], '{_OPENS}') THEN ls[1] END, '') AS greeting,
  coalesce(CASE WHEN len(ls) > 1 THEN list_filter(list_reverse(ls[-3:]), lambda x: regexp_matches(x, '{_ENDS}'))[1] END, '') AS closing, tone_hints,
  len(list_filter(string_split_regex(reply, '[ \t\n\r\f\x0b]+'), lambda x: x <> ''))::INT AS word_count, contains(tone_hints, 'uses_contractions') AS has_contractions FROM pr1)"""
)
_BODIES = rf""", ml AS (SELECT DISTINCT email.id, coalesce(email.body, f.body, email.snippet, '') AS body, coalesce(nullif(f.subject, ''), email.subject, '') AS subject, coalesce(nullif(f.sender, ''), from_addr, '') AS sender,
  CASE WHEN len(f.recipients) > 0 THEN f.recipients ELSE list_sort(list_distinct(regexp_extract_all(coalesce(to_addr, ''), '{_ADDR}'))) END AS rs, coalesce(f.cc, '') <> '' AS has_cc, coalesce(f.refs, 0) AS refs, coalesce(f.irt, false) AS irt,
  coalesce(f.att, 0) AS att, TRY_CAST(internal_date AS BIGINT) AS ms FROM email LEFT JOIN f ON f.id = email.id),
e2 AS (SELECT *, CASE WHEN ms BETWEEN 1 AND 253402300799999 THEN epoch_ms(ms) END AS tm, list_distinct(list_transform(rs, lambda x: lower(split_part(x, '@', 2)))) AS ds,
  lower(split_part(regexp_extract(lower(sender), '{_ADDR}'), '@', 2)) AS own, row_number() OVER () AS k FROM ml)"""
_FORM = ORACLES_OF_MAIL["agg_structure"].replace("WITH b AS (SELECT id,", "b AS (SELECT k AS id,").replace("FROM email)", "FROM e2)")
_FORM_HEAD, _FORM_TAIL = _FORM.split("\nSELECT id,", 1)

ORACLES = {
    "prj_body": f"{_FIELDS} SELECT id, subject, length(body) AS body_length, md5(body) AS body_md5 FROM f",
    "prj_headers": f"{_FIELDS} SELECT id, sender, cc, array_to_string(recipients, ',') AS recipients, len(recipients) AS n FROM f",
    "cls_thread": f"{_FIELDS} SELECT id, {_POSITION} FROM f",
    "cls_attachment": f"{_FIELDS} SELECT id, att AS attachments, att > 0 AS has_attachments FROM f",
    "prj_vector_text": rf"""
WITH l AS (SELECT id, coalesce(subject,'') AS s, list_filter(string_split(replace(coalesce(body,''), chr(13), ''), chr(10)), lambda x: NOT starts_with({_SP('x')}, '>')) AS ls FROM email),
p AS (SELECT *, list_position(list_transform(ls, lambda x: contains(x, 'wrote:') AND contains(x, 'On ')), true) AS k FROM l),
t AS (SELECT id, s, {_SP("coalesce(array_to_string(CASE WHEN k > 0 THEN ls[1:k-1] ELSE ls END, chr(10)), '')")} AS b FROM p),
j AS (SELECT id, CASE WHEN s <> '' AND NOT starts_with(lower(s), 're:') THEN s || chr(10) || chr(10) || b ELSE b END AS x FROM t),
c AS (SELECT id, CASE WHEN length(x) > 2000 THEN substr(x, 1, 2000) || '...' ELSE x END AS x FROM j) SELECT id, length(x) AS n, md5(x) AS text_md5 FROM c WHERE length(x) >= 10""",
    "prj_pairs": f"{_PAIRS} SELECT * FROM pr",
    "val_pairs": f"""{_PAIRS} SELECT count(*) AS pairs, round(avg(has_context::INT), 6) AS with_context, round(avg((greeting <> '')::INT), 6) AS with_greeting, round(avg(has_contractions::INT), 6) AS with_contractions FROM pr""",
    "prj_enrichment": f"""{_FIELDS}{_BODIES}, {_FORM_HEAD}, st AS (SELECT id AS k, {_FORM_TAIL})
SELECT DISTINCT e2.id, len(rs)::INT AS recipient_count, CASE WHEN len(rs)=1 THEN 'individual' WHEN len(rs)<=5 THEN 'small_group' WHEN len(rs)<=15 THEN 'team' ELSE 'broadcast' END AS recipient_type,
  CASE WHEN len(ds)=0 THEN 'unknown' WHEN len(list_filter(ds, lambda x: x=own))=len(ds) THEN 'internal' WHEN NOT list_contains(ds, own) THEN 'external' ELSE 'mixed' END AS audience, has_cc, {_POSITION}, att > 0 AS has_attachments,
  CASE WHEN tm IS NULL THEN 'unknown' WHEN hour(tm) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(tm) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(tm) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS time_of_day,
  coalesce(lower(dayname(tm)), 'unknown') AS day_of_week, isodow(tm) >= 6 AS is_weekend, char_count, paragraph_count, bullet_count, greeting, closing, bullet_count > 0 AS has_bullets FROM e2 JOIN st USING (k)""",
}
