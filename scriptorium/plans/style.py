"""Queries on the style of each account's mails."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import mail, style
from scriptorium.tables import spread, table

GROUP = "account_id"


def _query(function, enriched: bool = False):
    def query(spark, directory):
        df = spread(table(spark, directory, "email"))
        return function(mail.enrich(df) if enriched else df, GROUP)

    return query


def agg_all(spark, directory):
    """All six measures in one row an account."""
    return style.all_measures(spread(table(spark, directory, "email")), GROUP)


QUERIES = {
    "agg_rhythm": _query(style.rhythm),
    "agg_formatting": _query(style.formatting),
    "agg_greetings": _query(style.greetings),
    "agg_closings": _query(style.closings),
    "agg_signature": _query(style.signature_blocks),
    "agg_subjects": _query(style.subjects),
    "agg_mechanics": _query(style.mechanics),
    "cls_email_types": _query(style.email_types, enriched=True),
    "agg_all": agg_all,
}

_S = r"regexp_replace({}, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')"
_STRIP = lambda x: _S.format(x)
_B = "b AS (SELECT row_number() OVER () AS rid, account_id, replace(body, chr(13), '') AS bd FROM email WHERE coalesce(body,'') <> '')"
_L = rf"{_B}, l AS (SELECT *, list_filter(list_transform(string_split(bd, chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '') AS ls FROM b)"
_PARAS = rf"list_filter(list_transform(string_split(bd, chr(10)||chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '')"
# RE2 has no look-around: a marker is put between sentences instead.
_SENTS = rf"list_filter(list_transform(string_split(regexp_replace(p, '([.!?])[ \t\n\f\r]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {_STRIP('x')}), lambda x: x <> '')"
_CONTR = "|".join(mail.CONTRACTIONS).replace("'", "''")


def _case(labels) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{label}'" for p, label in labels) + " END"


def _shares(rows: str, label: str) -> str:
    return f"""c AS (SELECT account_id, {label}, count(*) AS n FROM ({rows}) WHERE {label} IS NOT NULL GROUP BY ALL)
    SELECT account_id, {label}, n, round(n / sum(n) OVER (PARTITION BY account_id), 2) AS ratio,
    row_number() OVER (PARTITION BY account_id ORDER BY n DESC, {label}) = 1 AS is_primary FROM c"""


_MECH = rf"""
{_B}, x AS (SELECT *, list_transform(regexp_extract_all(bd, '(?i)\b(?:{_CONTR})\b'), lambda c: lower(c)) AS cs FROM b),
u AS (SELECT account_id, unnest(cs) AS c FROM x), k AS (SELECT account_id, c, row_number() OVER (PARTITION BY account_id ORDER BY count(*) DESC, c) AS r FROM u GROUP BY account_id, c),
t AS (SELECT account_id, string_agg(c, ',' ORDER BY r) AS common_contractions FROM k WHERE r <= 5 GROUP BY account_id),
g AS (SELECT account_id, count(*) FILTER (len(cs) > 0) > count(*) * 0.3 AS uses_contractions, round(count(*) FILTER (len(cs) > 0) / count(*), 2) AS contraction_rate,
 count(*) FILTER (regexp_matches(bd, '--|—|–')) > count(*) * 0.1 AS uses_em_dash, count(*) FILTER (contains(bd, ';')) > count(*) * 0.1 AS uses_semicolons,
 count(*) FILTER (regexp_matches(bd, '\.\.\.|…')) > count(*) * 0.1 AS uses_ellipsis, round(avg(length(bd) - length(replace(bd, '!', ''))), 2) AS exclamation_rate,
 round(avg(length(bd) - length(replace(bd, '?', ''))), 2) AS question_rate FROM x GROUP BY account_id),
mech AS (SELECT g.*, coalesce(common_contractions, '') AS common_contractions FROM g LEFT JOIN t ON g.account_id IS NOT DISTINCT FROM t.account_id)
"""
_RHYTHM = rf"""
rp AS (SELECT account_id, unnest({_PARAS}) AS p FROM b), rq AS (SELECT account_id, list_transform({_SENTS}, lambda s: len(string_split_regex(s, '[ \t\n\f\r]+'))) AS ns FROM rp WHERE length(p) >= 20),
ra AS (SELECT account_id, count(*) AS paras, count(*) FILTER (len(ns)=1) AS singles, sum(len(ns)) AS sents, sum(list_sum(ns)) AS words, sum(len(list_filter(ns, lambda n: n<8))) AS sh,
 sum(len(list_filter(ns, lambda n: n>=8 AND n<=20))) AS me, sum(len(list_filter(ns, lambda n: n>20))) AS lo FROM rq GROUP BY account_id),
rhythm AS (SELECT account_id, round(words/sents, 1) AS avg_words_per_sentence, round(sh/sents, 2) AS lt_8_words_ratio, round(me/sents, 2) AS words_8_to_20_ratio, round(lo/sents, 2) AS gt_20_words_ratio,
 round(sents/paras, 1) AS avg_sentences_per_paragraph, singles/paras > 0.2 AS uses_single_sentence_paragraphs, CASE WHEN sents/paras <= 2 THEN 'low' WHEN sents/paras <= 4 THEN 'medium' ELSE 'high' END AS visual_density FROM ra)
"""
_FORMAT = rf"""
fb AS (SELECT account_id, replace(coalesce(body,''), chr(13), '') AS bd FROM email),
fa AS (SELECT account_id, avg(regexp_matches(bd, '(?m)^\s*[*-]\s+')::INT) AS bu, avg(regexp_matches(bd, '(?m)^\s*\d+[.)]\s+')::INT) AS nu, coalesce(avg(CASE WHEN bd <> '' THEN len({_PARAS}) END), 0) AS m FROM fb GROUP BY account_id),
fmt AS (SELECT account_id, round(bu, 2) AS uses_bullets_rate, round(nu, 2) AS uses_numbering_rate, round(m, 1) AS avg_paragraphs_per_email, CASE WHEN m <= 2 THEN 'low' WHEN m <= 4 THEN 'medium' ELSE 'high' END AS line_break_frequency FROM fa)
"""

ORACLES = {
    "agg_rhythm": f"WITH {_B}, {_RHYTHM} SELECT * FROM rhythm",
    "agg_formatting": f"WITH {_FORMAT} SELECT * FROM fmt",
    "agg_greetings": f"WITH {_L}, f AS (SELECT account_id, ls[1] AS x FROM l), " + _shares(f"SELECT account_id, {_case(style.GREETINGS)} AS greeting FROM f", "greeting"),
    "agg_closings": f"WITH {_L}, " + _shares(f"SELECT account_id, list_filter(list_transform(list_reverse(ls[-5:]), lambda x: {_case(style.CLOSINGS)}), lambda y: y IS NOT NULL)[1] AS closing FROM l", "closing"),
    "agg_signature": rf"""WITH s AS (SELECT account_id, list_filter(list_transform(string_split(replace(coalesce(body,''), chr(13), ''), chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> '') AS ls FROM email),
      t AS (SELECT account_id, len(ls) >= 3 AND regexp_matches(array_to_string(ls[-3:], chr(10)), '(?m)@\w+\.\w+|^\d{{3}}[-.\s]?\d{{3}}[-.\s]?\d{{4}}$') AS f FROM s)
      SELECT account_id, round(avg(f::INT), 4) AS signature_rate, sum(f::INT) > count(*) * 0.3 AS uses_signature_block FROM t GROUP BY account_id""",
    "agg_subjects": rf"""
WITH s AS (SELECT account_id, subject AS s, {_STRIP("regexp_replace(subject, '(?i)^(Re:|Fwd:|FYI:|FW:)[ \t\n\f\r]*', '')")} AS c, regexp_extract(subject, '(?i)^(Re:|Fwd:|FYI:|FW:|Action:|Update:|Reminder:)', 1) AS p FROM email WHERE coalesce(subject,'') <> ''),
k AS (SELECT *, regexp_extract_all(c, '\p{{L}}+') AS rs FROM s),
d AS (SELECT *, CASE WHEN c = '' THEN NULL WHEN regexp_matches(c, '\p{{L}}') AND c = upper(c) AND NOT regexp_matches(c, '\p{{Ll}}') THEN 'all_caps' WHEN regexp_matches(c, '\p{{L}}') AND c = lower(c) AND NOT regexp_matches(c, '\p{{Lu}}') THEN 'lowercase'
  WHEN regexp_matches(c, '^\p{{Lu}}') AND NOT (len(rs) > 0 AND len(list_filter(rs, lambda w: NOT regexp_matches(w, '^\p{{Lu}}\p{{Ll}}*$'))) = 0) THEN 'sentence_case' ELSE 'title_case' END AS k FROM k),
pp AS (SELECT account_id, p, row_number() OVER (PARTITION BY account_id ORDER BY count(*) DESC, p) AS r FROM s WHERE p <> '' GROUP BY account_id, p),
t AS (SELECT account_id, string_agg(p, ',' ORDER BY r) AS cp FROM pp WHERE r <= 5 GROUP BY account_id),
g AS (SELECT account_id, min(length(s)) AS min_chars, max(length(s)) AS max_chars, round(avg(len(list_filter(string_split_regex(s, '[ \t\n\f\r]+'), lambda x: x <> ''))), 1) AS avg_word_count,
 round(count(*) FILTER (k='title_case') / nullif(count(k), 0), 2) AS title_case, round(count(*) FILTER (k='sentence_case') / nullif(count(k), 0), 2) AS sentence_case, round(count(*) FILTER (k='all_caps') / nullif(count(k), 0), 2) AS all_caps,
 round(count(*) FILTER (k='lowercase') / nullif(count(k), 0), 2) AS lowercase, round(avg(regexp_matches(s, '\[.*?\]')::INT), 2) AS uses_brackets_rate FROM d GROUP BY account_id)
SELECT g.*, coalesce(cp, '') AS common_prefixes FROM g LEFT JOIN t ON g.account_id = t.account_id""",
    "agg_mechanics": f"WITH {_MECH} SELECT * FROM mech",
    "cls_email_types": rf"""
WITH a AS (SELECT account_id, coalesce(body,'') AS b0, lower(coalesce(body,'')) AS b, list_distinct(list_transform(regexp_extract_all(lower(coalesce(to_addr,'')), '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[a-zA-Z]{{2,}}'), lambda x: split_part(x,'@',2))) AS ds,
  split_part(regexp_extract(lower(coalesce(from_addr,'')), '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_.-]+\.[a-zA-Z]{{2,}}'), '@', 2) AS own FROM email),
g AS (SELECT account_id, avg(regexp_matches(b, 'status|update|progress|completed|in progress|blocked|milestone')::INT) AS s, avg(regexp_matches(b, 'reach out|reaching out|introduce|opportunity|connect|partnership')::INT) AS o,
  avg(regexp_matches(b, 'could you|can you|please|would you|need you to|request')::INT) AS r, avg(regexp_matches(b0, '(?m)^\s*[-*•]\s+')::INT) AS bu, avg((len(ds) > 0 AND NOT list_contains(ds, own))::INT) AS x, avg(length(b)) AS ml FROM a GROUP BY account_id)
SELECT account_id, CASE WHEN s > 0.5 AND bu > 0.4 THEN 'internal_status_update' WHEN o > 0.4 AND x > 0.5 THEN 'cold_outreach' WHEN r > 0.5 THEN 'request' ELSE 'general' END AS email_type,
 round(CASE WHEN s > 0.5 AND bu > 0.4 THEN least(0.9, s + 0.3 * bu) WHEN o > 0.4 AND x > 0.5 THEN least(0.85, o + 0.2) WHEN r > 0.5 THEN least(0.8, r) ELSE 0.6 END, 4) AS confidence,
 floor(ml * 0.5)::BIGINT AS min_length, floor(ml * 1.5)::BIGINT AS max_length FROM g""",
}

ORACLES["agg_all"] = f"""SELECT f.*, r.* EXCLUDE (account_id), g.greeting AS primary_greeting, g.ratio AS greeting_ratio, c.closing AS primary_closing, c.ratio AS closing_ratio, s.* EXCLUDE (account_id), j.* EXCLUDE (account_id), m.* EXCLUDE (account_id)
  FROM ({ORACLES['agg_formatting']}) f LEFT JOIN ({ORACLES['agg_rhythm']}) r USING (account_id) LEFT JOIN (SELECT * FROM ({ORACLES['agg_greetings']}) WHERE is_primary) g USING (account_id)
  LEFT JOIN (SELECT * FROM ({ORACLES['agg_closings']}) WHERE is_primary) c USING (account_id) LEFT JOIN ({ORACLES['agg_signature']}) s USING (account_id) LEFT JOIN ({ORACLES['agg_subjects']}) j USING (account_id)
  LEFT JOIN ({ORACLES['agg_mechanics']}) m USING (account_id)"""
