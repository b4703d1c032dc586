"""Queries on single mails and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import mail
from scriptorium.tables import spread, table


def _email(spark: SparkSession, directory: str) -> DataFrame:
    return spread(table(spark, directory, "email"))


def flt_accept(spark: SparkSession, directory: str) -> DataFrame:
    """Each mail with the first rule that rejects it, and its quality."""
    return mail.accept(_email(spark, directory)).select("id", "body_length", "original_length", "recipient_count", "quality_score", "reason")


def grp_reasons(spark: SparkSession, directory: str) -> DataFrame:
    """Mails by reason of rejection, with the quality's buckets of the accepted."""
    done = mail.accept(_email(spark, directory))
    return done.groupBy("reason").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("quality_score") >= 0.7).alias("high"),
        F.count_if((F.col("quality_score") >= 0.4) & (F.col("quality_score") < 0.7)).alias("medium"),
        F.round(F.avg("quality_score"), 6).alias("mean_quality"),
    )


def cls_enrich(spark: SparkSession, directory: str) -> DataFrame:
    """Recipients, audience, thread position and time of each mail."""
    columns = ["id", "recipient_count", "recipient_type", "audience", "thread_position", "thread_depth", "time_of_day", "day_of_week", "is_weekend"]
    return mail.enrich(_email(spark, directory)).select(*columns, F.array_join("recipient_domains", ",").alias("recipient_domains"))


def grp_dimensions(spark: SparkSession, directory: str) -> DataFrame:
    """Counts of five dimensions in one pass, each mail expanded to its five values before a partial aggregation."""
    done = mail.enrich(_email(spark, directory))
    names = ["recipient_type", "audience", "thread_position", "time_of_day", "day_of_week"]
    return done.unpivot([], names, "dimension", "value").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def agg_structure(spark: SparkSession, directory: str) -> DataFrame:
    """Structure of each mail."""
    columns = ["id", "char_count", "line_count", "paragraph_count", "bullet_count", "greeting", "closing"]
    return mail.structure(_email(spark, directory)).select(*columns, F.round("avg_paragraph_length", 6).alias("avg_paragraph_length"))


def prj_reply(spark: SparkSession, directory: str) -> DataFrame:
    """Quoted and newly written text by the simple rule, with hashes of both and hints of tone."""
    done = mail.split_reply(_email(spark, directory).select("id", "body"))
    return done.select(
        "id",
        F.length("quoted_text").alias("quoted_length"),
        F.md5("quoted_text").alias("quoted_md5"),
        F.md5("reply_text").alias("reply_md5"),
        F.array_join(mail.tone_hints(F.col("reply_text")), ",").alias("tone_hints"),
    )


def cls_seniority(spark: SparkSession, directory: str) -> DataFrame:
    """Whom each mail addresses, by recipients and the signature."""
    done = mail.enrich(_email(spark, directory))
    return done.select("id", mail.seniority(F.col("to_addr"), mail.signature(F.col("body")), F.col("from_addr"), F.col("body"), F.col("audience")).alias("seniority"))


def prj_hash(spark: SparkSession, directory: str) -> DataFrame:
    """Analysed mails whose recorded hash is not that of the mail's text."""
    samples = table(spark, directory, "samples").select("email_id", F.lower("content_hash").alias("content_hash")).distinct()
    hashes = _email(spark, directory).select(F.col("id").alias("email_id"), F.substring(F.md5(F.coalesce("body", F.lit(""))), 1, 12).alias("actual")).distinct()
    return samples.join(hashes, "email_id").select("email_id", "content_hash", "actual", (F.col("content_hash") == F.col("actual")).alias("same"))


def src_times(spark: SparkSession, directory: str) -> DataFrame:
    """Event time in milliseconds, 0 where it can't be read, with the water marks of each account."""
    ms = F.coalesce(F.col("internal_date").try_cast("bigint"), F.lit(0).cast("bigint"))
    rows = _email(spark, directory).select("account_id", "id", ms.alias("ms"))
    return rows.groupBy("account_id").agg(F.countDistinct("id").alias("fetched"), F.max("ms").alias("newest"), F.min(F.when(F.col("ms") > 0, F.col("ms"))).alias("oldest"))


def set_latest(spark: SparkSession, directory: str) -> DataFrame:
    """Each mail once, as last fetched; equal times go by label list."""
    rows = _email(spark, directory).select("id", F.struct("fetched_at", F.coalesce(F.array_join("label_ids", ","), F.lit("")).alias("labels")).alias("s"))
    return rows.groupBy("id").agg(F.max("s").alias("s"), F.count("*").alias("copies")).select("id", "s.fetched_at", "s.labels", "copies")


def set_holdout(spark: SparkSession, directory: str) -> DataFrame:
    """A fifth of the mails, chosen by hash, by account: a repeatable split."""
    rows = _email(spark, directory).select("account_id", "id").distinct()
    held = F.conv(F.substring(F.md5("id"), 1, 6), 16, 10).cast("long") % 10000 < 2000
    return rows.groupBy("account_id").agg(F.count_if(held).alias("held"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (flt_accept, grp_reasons, cls_enrich, grp_dimensions, agg_structure, prj_reply, cls_seniority, prj_hash, src_times, set_latest, set_holdout)
}

_STRIP = r"regexp_replace({}, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')"
_ADDR = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-zA-Z]{2,}"


def _strip(x: str) -> str:
    return _STRIP.format(x)


_ORIGINAL = rf"""
b AS (SELECT *, coalesce(body,'') AS bd, coalesce(subject,'') AS sj, string_split(replace(coalesce(body,''), chr(13), ''), chr(10)) AS ls FROM email),
o1 AS (SELECT *, list_position(list_transform(ls, lambda x: regexp_matches(x, '(?i)^On .+ wrote:$|^-{{3,}}\s*Original Message\s*-{{3,}}')), true) AS fp FROM b),
o2 AS (SELECT *, list_filter(CASE WHEN fp > 0 THEN ls[1:fp-1] ELSE ls END, lambda x: NOT starts_with(x, '>')) AS k1 FROM o1),
o3 AS (SELECT *, list_position(list_transform(k1, lambda x: NOT starts_with(x, 'From:')), true) AS sp FROM o2),
o AS (SELECT *, coalesce(array_to_string(CASE WHEN sp > 0 THEN k1[sp:] ELSE [] END, chr(10)), '') AS original,
      len(list_distinct(regexp_extract_all(lower(coalesce(to_addr,'')), '{_ADDR}'))) AS rc FROM o3),
w AS (SELECT *, regexp_extract_all(lower(original), '[\p{{L}}\p{{N}}_]+') AS ws FROM o),
q AS (SELECT *, (CASE WHEN length(original)<50 THEN 0.1 WHEN length(original)<100 THEN 0.3 WHEN length(original)<200 THEN 0.6 WHEN length(original)<500 THEN 0.8 ELSE 1.0 END)::DOUBLE*0.4
      + (CASE WHEN length(bd)>0 THEN length(original)/length(bd) ELSE 0 END)::DOUBLE*0.3 + (CASE WHEN len(ws)>0 THEN len(list_distinct(ws))/len(ws) ELSE 0 END)::DOUBLE*0.3 AS score FROM w),
r AS (SELECT *, CASE
  WHEN {_strip('bd')} = '' THEN 'empty_body'
  WHEN length({_strip('original')}) < 100 THEN 'too_short'
  WHEN regexp_matches(bd, '(?im)^-{{5,}}\s*Forwarded|^Begin forwarded message|^Fwd:|^FW:') OR regexp_matches(sj, '(?im)^Fwd:|^FW:') THEN 'forward'
  WHEN regexp_matches(bd || chr(10) || chr(10) || sj, '(?im)Out of Office|Automatic reply|Auto-Reply|I am currently out|Thank you for your email. I am away|This is an automated response|I''m out of the office|will respond when I return') THEN 'auto_reply'
  WHEN regexp_matches(bd || chr(10) || sj, '(?im)^Accepted:|^Declined:|^Tentative:|^Invitation:|has accepted your meeting|has declined your meeting|Calendar:') THEN 'calendar_response'
  WHEN rc > 20 THEN 'mass_email' WHEN score < 0.3 THEN 'low_quality' ELSE '' END AS reason FROM q),
f AS (SELECT id, length(bd) AS body_length, length(original) AS original_length, rc::INT AS recipient_count,
      CASE WHEN reason IN ('','low_quality') THEN round(score, 3) ELSE 0.0 END AS quality_score, reason FROM r)
"""

_ENRICHED = rf"""
a AS (SELECT *, list_distinct(regexp_extract_all(lower(coalesce(to_addr,'')), '{_ADDR}')) AS rs,
      split_part(regexp_extract(lower(coalesce(from_addr,'')), '{_ADDR}'), '@', 2) AS own, lower({_strip("coalesce(subject,'')")}) AS sl,
      TRY_CAST(internal_date AS BIGINT) AS ms0 FROM email),
c AS (SELECT *, list_sort(list_distinct(list_transform(rs, lambda x: split_part(x, '@', 2)))) AS ds,
      CASE WHEN ms0 BETWEEN 1 AND 253402300799999 THEN epoch_ms(ms0) END AS tm FROM a),
e AS (SELECT id, to_addr, from_addr, body, len(rs)::INT AS recipient_count,
  CASE WHEN len(rs)=1 THEN 'individual' WHEN len(rs)<=5 THEN 'small_group' WHEN len(rs)<=15 THEN 'team' ELSE 'broadcast' END AS recipient_type,
  array_to_string(ds, ',') AS recipient_domains,
  CASE WHEN len(ds)=0 THEN 'unknown' WHEN len(list_filter(ds, lambda x: x=own))=len(ds) THEN 'internal' WHEN len(list_filter(ds, lambda x: x=own))=0 THEN 'external' ELSE 'mixed' END AS audience,
  CASE WHEN regexp_matches(sl,'^(fwd:|fw:)') THEN 'forward' WHEN starts_with(sl,'re:') THEN 'reply' ELSE 'initiating' END AS thread_position,
  CASE WHEN regexp_matches(sl,'^(fwd:|fw:|re:)') THEN 1 ELSE 0 END AS thread_depth,
  CASE WHEN tm IS NULL THEN 'unknown' WHEN hour(tm) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(tm) BETWEEN 12 AND 16 THEN 'afternoon' WHEN hour(tm) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS time_of_day,
  coalesce(lower(dayname(tm)), 'unknown') AS day_of_week, isodow(tm) >= 6 AS is_weekend FROM c)
"""

_TONE = "|".join(c for c in mail.CONTRACTIONS if c != "let's").replace("'", "''")

ORACLES = {
    "flt_accept": f"WITH {_ORIGINAL} SELECT * FROM f",
    "grp_reasons": f"""WITH {_ORIGINAL} SELECT reason, count(*) AS n, count(*) FILTER (quality_score >= 0.7) AS high,
        count(*) FILTER (quality_score >= 0.4 AND quality_score < 0.7) AS medium, round(avg(quality_score), 6) AS mean_quality FROM f GROUP BY reason""",
    "cls_enrich": f"WITH {_ENRICHED} SELECT * EXCLUDE (to_addr, from_addr, body) FROM e",
    "grp_dimensions": f"""WITH {_ENRICHED} SELECT dimension, value, count(*) AS n FROM (
        UNPIVOT (SELECT recipient_type, audience, thread_position, time_of_day, day_of_week FROM e)
        ON recipient_type, audience, thread_position, time_of_day, day_of_week INTO NAME dimension VALUE value) GROUP BY ALL""",
    "agg_structure": rf"""
WITH b AS (SELECT id, replace(coalesce(body,''), chr(13), '') AS bd FROM email),
l AS (SELECT *, string_split(bd, chr(10)) AS ls FROM b),
n AS (SELECT *, list_filter(list_transform(ls, lambda x: {_strip('x')}), lambda x: x <> '') AS fl,
  list_filter(list_transform(string_split_regex(array_to_string(list_transform(ls, lambda x: CASE WHEN {_strip('x')}='' THEN '' ELSE x END), chr(10)), '\n\n+'),
     lambda p: regexp_replace(p, '^\n+|\n+$', '', 'g')), lambda p: p <> '') AS ps FROM l)
SELECT id, length(bd) AS char_count, len(ls) AS line_count, len(ps) AS paragraph_count,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t\n\f\r]*(?:[•*-]|\d+[.)-])[ \t\n\f\r]+'))) AS bullet_count,
  list_filter(fl[1:3], lambda x: regexp_matches(x, '(?i)^(?:(?:Hey|Hi|Hello|Dear|Good morning|Good afternoon)\b|[\p{{L}}\p{{N}}_]+,?$)'))[1] AS greeting,
  list_filter(list_reverse(fl[-5:]), lambda x: regexp_matches(x, '(?i)^(?:Best|Thanks|Cheers|Regards|Sincerely|Talk soon|-\s*[\p{{L}}\p{{N}}_]+$|[\p{{L}}\p{{N}}_]{{1,3}}$)'))[1] AS closing,
  round(coalesce(list_sum(list_transform(ps, lambda p: length(p))), 0) / greatest(len(ps), 1), 6) AS avg_paragraph_length FROM n""",
    "prj_reply": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, id, string_split(replace(coalesce(body,''), chr(13), ''), chr(10)) AS ls FROM email),
x AS (SELECT rid, id, unnest(ls) AS t, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, {_strip('t')} AS s, CASE WHEN regexp_matches({_strip('t')}, '^[>|]') THEN 'q' WHEN regexp_matches({_strip('t')}, '(?i)^On .+wrote:?$') THEN 'w'
      WHEN {_strip('t')} = '' THEN 'b' ELSE 'o' END AS k FROM x),
n AS (SELECT *, coalesce(lead(k) OVER (PARTITION BY rid ORDER BY i), 'end') AS nx FROM k),
st AS (SELECT *, coalesce(max(CASE WHEN k IN ('q','w') THEN i END) OVER w, -1) > coalesce(max(CASE WHEN k='b' AND nx<>'q' THEN i END) OVER w, -1) AS st
       FROM n WINDOW w AS (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT rid, id, i, CASE WHEN k='q' THEN {_strip("regexp_replace(s, '^[>|]+', '')")} WHEN st AND k='b' AND nx='q' THEN '' WHEN st AND k='o' THEN s END AS q,
       CASE WHEN NOT st AND k IN ('b','o') THEN t WHEN st AND k='b' AND nx NOT IN ('q','end') THEN t END AS r FROM st),
g AS (SELECT rid, id, {_strip("coalesce(string_agg(q, chr(10) ORDER BY i), '')")} AS quoted, {_strip("coalesce(string_agg(r, chr(10) ORDER BY i), '')")} AS reply FROM v GROUP BY rid, id)
SELECT id, length(quoted) AS quoted_length, md5(quoted) AS quoted_md5, md5(reply) AS reply_md5, CASE WHEN reply='' THEN '' ELSE array_to_string(list_filter([
  CASE WHEN regexp_matches(lower(reply), 'dear |sincerely|kind regards|respectfully') THEN 'formal' END,
  CASE WHEN regexp_matches(lower(reply), 'hey |lol|haha|!!') THEN 'casual' END,
  CASE WHEN regexp_matches(lower(reply), 'hope you|thank you so much|really appreciate|wonderful') THEN 'warm' END,
  CASE WHEN length(reply) - length(replace(reply,'?','')) > 2 THEN 'inquisitive' END, CASE WHEN length(reply) < 100 THEN 'concise' END, CASE WHEN length(reply) > 500 THEN 'detailed' END,
  CASE WHEN regexp_matches(replace(replace(reply, '’', ''''), '‘', ''''), '(?i)\b(?:{_TONE})\b') THEN 'uses_contractions' END], lambda x: x IS NOT NULL), ',') END AS tone_hints FROM g""",
    "cls_seniority": rf"""WITH {_ENRICHED}, sg AS (SELECT *, list_reverse(list_filter(list_transform(string_split(replace(coalesce(body,''), chr(13), ''), chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')) AS ls FROM e),
   sk AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '{mail.CLOSING}')), true), 0) AS k FROM sg),
   z AS (SELECT *, concat_ws(' ', coalesce(to_addr,''), CASE WHEN k > 1 THEN array_to_string(list_reverse(ls[1:k-1]), chr(10)) ELSE '' END) AS tx,
   lower(regexp_extract(coalesce(to_addr,''), '@([\p{{L}}\p{{N}}_.-]+)', 1)) AS th, lower(regexp_extract(coalesce(from_addr,''), '@([\p{{L}}\p{{N}}_.-]+)', 1)) AS he FROM sk)
  SELECT id, CASE WHEN regexp_matches(tx, '(?i){mail.EXECUTIVE}') THEN 'executive' WHEN audience='external' OR (th<>'' AND he<>'' AND th<>he) THEN 'external_client'
   WHEN regexp_matches(coalesce(body,''), '(?i){mail.RECRUITING}') THEN 'candidate' WHEN regexp_matches(tx, '(?i){mail.JUNIOR}') THEN 'report'
   WHEN audience='internal' OR (audience='' AND coalesce(to_addr,'')='') THEN 'peer' ELSE 'unknown' END AS seniority FROM z""",
    "prj_hash": """SELECT email_id, content_hash, actual, content_hash = actual AS same FROM (SELECT DISTINCT email_id, lower(content_hash) AS content_hash FROM samples) s
   JOIN (SELECT DISTINCT id AS email_id, substr(md5(coalesce(body,'')), 1, 12) AS actual FROM email) e USING (email_id)""",
    "src_times": """SELECT account_id, count(DISTINCT id) AS fetched, max(ms) AS newest, min(CASE WHEN ms > 0 THEN ms END) AS oldest
   FROM (SELECT account_id, id, coalesce(TRY_CAST(internal_date AS BIGINT), 0) AS ms FROM email) GROUP BY account_id""",
    "set_latest": """SELECT id, fetched_at, labels, copies FROM (SELECT id, fetched_at, coalesce(array_to_string(label_ids, ','), '') AS labels, count(*) OVER (PARTITION BY id) AS copies,
   row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, coalesce(array_to_string(label_ids, ','), '') DESC) AS k FROM email) WHERE k = 1""",
    "set_holdout": """SELECT account_id, count(*) FILTER (('0x' || substr(md5(id), 1, 6))::BIGINT % 10000 < 2000) AS held, count(*) AS n
   FROM (SELECT DISTINCT account_id, id FROM email) GROUP BY account_id""",
}
