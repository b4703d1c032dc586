"""Style measures of groups of mails, one row a group.

Per-mail measures are array expressions without a shuffle; only their sums are grouped,
with partial aggregation, so a group of any share of the mails is fine. Labels are counted
by group and label before the best are chosen. Ties in a label's count go by the label.
Null and empty bodies count in the number of mails where a measure says so, else not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators.mail import CONTRACTIONS

# Greeting and closing lines with their labels, in order.
GREETINGS = [
    (r"(?i)^Hey\s+\w+,?", "Hey {name},"), (r"(?i)^Hi\s+\w+,?", "Hi {name},"), (r"(?i)^Hello\s+\w+,?", "Hello {name},"), (r"(?i)^Dear\s+\w+,?", "Dear {name},"),
    (r"(?i)^Hey,?$", "Hey,"), (r"(?i)^Hi,?$", "Hi,"), (r"(?i)^Hello,?$", "Hello,"), (r"(?i)^Team,?$", "Team,"), (r"(?i)^All,?$", "All,"),
    (r"(?i)^Everyone,?$", "Everyone,"), (r"^[A-Z][a-z]+,?$", "{name},"),
]
CLOSINGS = [
    (r"(?i)^Thanks,?$", "Thanks,"), (r"(?i)^Thank you,?$", "Thank you,"), (r"(?i)^Best,?$", "Best,"), (r"(?i)^Best regards,?$", "Best regards,"),
    (r"(?i)^Regards,?$", "Regards,"), (r"(?i)^Cheers,?$", "Cheers,"), (r"(?i)^Appreciate it,?$", "Appreciate it,"), (r"(?i)^[-—]\s*\w+$", "-{name}"),
]
_PREFIX = r"(?i)^(Re:|Fwd:|FYI:|FW:|Action:|Update:|Reminder:)"


def _filled(df: DataFrame, body: str) -> DataFrame:
    return df.where(F.coalesce(F.col(body), F.lit("")) != "").withColumn("_b", F.replace(F.col(body), F.lit("\r"), F.lit("")))


def paragraphs(body: Column) -> Column:
    return T.filled(F.split(body, "\n\n", -1))


def sentences(text: Column) -> Column:
    """Cuts after a sentence's end before white space and a capital letter."""
    return T.filled(F.split(text, r"(?<=[.!?])[ \t\n\f\r]+(?=[A-Z])", -1))


def density(mean: Column) -> Column:
    return F.when(mean <= 2, "low").when(mean <= 4, "medium").otherwise("high")


def rhythm(df: DataFrame, group: str, body: str = "body") -> DataFrame:
    """Sentence lengths and sentences a paragraph, over paragraphs of 20 characters or more."""
    paras = F.filter(paragraphs(F.col("_b")), lambda p: F.length(p) >= 20)
    counted = F.transform(paras, lambda p: F.transform(sentences(p), lambda s: F.size(F.split(s, r"[ \t\n\f\r]+", -1))))
    rows = _filled(df, body).select(F.col(group).alias("g"), counted.alias("p"))
    all_ = F.flatten("p")
    size = lambda c: F.size(c)
    per_mail = rows.select(
        "g",
        F.size(F.col("p")).alias("paras"),
        size(F.filter("p", lambda x: F.size(x) == 1)).alias("singles"),
        size(all_).alias("sents"),
        F.aggregate(all_, F.lit(0), lambda a, x: a + x).alias("words"),
        size(F.filter(all_, lambda n: n < 8)).alias("short"),
        size(F.filter(all_, lambda n: (n >= 8) & (n <= 20))).alias("medium"),
        size(F.filter(all_, lambda n: n > 20)).alias("long"),
    )
    sums = per_mail.groupBy("g").agg(*(F.sum(c).alias(c) for c in per_mail.columns[1:])).where("sents > 0")
    mean = F.col("sents") / F.col("paras")
    share = lambda c: F.round(F.col(c) / F.col("sents"), 2)
    return sums.select(
        F.col("g").alias(group),
        F.round(F.col("words") / F.col("sents"), 1).alias("avg_words_per_sentence"),
        share("short").alias("lt_8_words_ratio"),
        share("medium").alias("words_8_to_20_ratio"),
        share("long").alias("gt_20_words_ratio"),
        F.round(mean, 1).alias("avg_sentences_per_paragraph"),
        (F.col("singles") / F.col("paras") > 0.2).alias("uses_single_sentence_paragraphs"),
        density(mean).alias("visual_density"),
    )


def formatting(df: DataFrame, group: str, body: str = "body") -> DataFrame:
    """Shares of mails with bullets and numbers (of all mails), paragraphs a mail (of those with a body)."""
    text = F.replace(F.coalesce(F.col(body), F.lit("")), F.lit("\r"), F.lit(""))
    rows = df.select(F.col(group).alias("g"), text.alias("b"))
    mean = F.avg(F.when(F.col("b") != "", F.size(paragraphs(F.col("b")))))
    found = lambda p: F.avg(F.col("b").rlike(p).cast("int"))
    out = rows.groupBy("g").agg(
        F.round(found(r"(?m)^\s*[*-]\s+"), 2).alias("uses_bullets_rate"),
        F.round(found(r"(?m)^\s*\d+[.)]\s+"), 2).alias("uses_numbering_rate"),
        F.coalesce(mean, F.lit(0.0)).alias("m"),
    )
    return out.select(
        F.col("g").alias(group), "uses_bullets_rate", "uses_numbering_rate",
        F.round("m", 1).alias("avg_paragraphs_per_email"), density(F.col("m")).alias("line_break_frequency"),
    )


def shares(labels: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label, n, ratio, primary): each label's share in its group and whether it leads."""
    counts = labels.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    best = Window.partitionBy(group).orderBy(F.desc("n"), label)
    return counts.select(
        group, label, "n", F.round(F.col("n") / F.sum("n").over(whole), 2).alias("ratio"), (F.row_number().over(best) == 1).alias("is_primary")
    )


def greetings(df: DataFrame, group: str, body: str = "body") -> DataFrame:
    """Shares of the greetings in the first line."""
    first = F.get(T.filled(T.lines(F.col("_b"))), F.lit(0))
    rows = _filled(df, body).select(F.col(group), T.first_label(first, GREETINGS).alias("greeting"))
    return shares(rows, group, "greeting")


def closings(df: DataFrame, group: str, body: str = "body") -> DataFrame:
    """Shares of the closings: of the last five lines, from the end, the first that is one."""
    lines = T.filled(T.lines(F.col("_b")))
    last = F.when(F.size(lines) > 0, F.reverse(F.slice(lines, -F.least(F.size(lines), F.lit(5)), F.lit(5))))
    label = F.get(F.filter(F.transform(last, lambda x: T.first_label(x, CLOSINGS)), lambda x: x.isNotNull()), F.lit(0))
    return shares(_filled(df, body).select(F.col(group), label.alias("closing")), group, "closing")


def signature_blocks(df: DataFrame, group: str, body: str = "body") -> DataFrame:
    """Whether more than 0.3 of a group's mails end in three lines with an address or a ten-digit number."""
    text = F.replace(F.coalesce(F.col(body), F.lit("")), F.lit("\r"), F.lit(""))
    lines = T.filled(T.lines(text))
    end = F.array_join(F.when(F.size(lines) >= 3, F.slice(lines, -3, 3)), "\n")
    found = F.coalesce(end.rlike(r"(?m)@\w+\.\w+|^\d{3}[-.\s]?\d{3}[-.\s]?\d{4}$"), F.lit(False))
    rate = F.avg(found.cast("int"))
    return df.groupBy(group).agg(F.round(rate, 4).alias("signature_rate"), (F.sum(found.cast("int")) > F.count("*") * 0.3).alias("uses_signature_block"))


def subjects(df: DataFrame, group: str, subject: str = "subject") -> DataFrame:
    """Lengths, words, casing, brackets of subjects and the five most used prefixes.

    Title case: each run of letters begins with a capital and goes on in small letters.
    """
    s = F.col("s")
    clean = T.strip(F.regexp_replace(s, r"(?i)^(Re:|Fwd:|FYI:|FW:)\s*", ""))
    letters = clean.rlike(r"\p{L}")
    runs = F.regexp_extract_all(clean, F.lit(r"\p{L}+"), F.lit(0))
    title = F.forall(runs, lambda w: w.rlike(r"^\p{Lu}\p{Ll}*$")) & (F.size(runs) > 0)
    casing = (
        F.when(clean == "", None)
        .when(letters & (clean == F.upper(clean)) & ~clean.rlike(r"\p{Ll}"), "all_caps")
        .when(letters & (clean == F.lower(clean)) & ~clean.rlike(r"\p{Lu}"), "lowercase")
        .when(clean.rlike(r"^\p{Lu}") & ~title, "sentence_case")
        .otherwise("title_case")
    )
    rows = df.where(F.coalesce(F.col(subject), F.lit("")) != "").select(F.col(group).alias("g"), F.col(subject).alias("s"))
    rows = rows.select("g", "s", casing.alias("c"), F.regexp_extract("s", _PREFIX, 1).alias("p"))
    words = F.size(T.filled(F.split("s", r"[ \t\n\f\r]+", -1)))
    rate = lambda k: F.round(F.count_if(F.col("c") == k) / F.nullif(F.count("c"), F.lit(0)), 2)
    out = rows.groupBy("g").agg(
        F.min(F.length("s")).alias("min_chars"), F.max(F.length("s")).alias("max_chars"), F.round(F.avg(words), 1).alias("avg_word_count"),
        *(rate(k).alias(k) for k in ("title_case", "sentence_case", "all_caps", "lowercase")),
        F.round(F.avg(F.col("s").rlike(r"\[.*?\]").cast("int")), 2).alias("uses_brackets_rate"),
    )
    counts = rows.where("p <> ''").groupBy("g", "p").count()
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("count"), "p"))).where("k <= 5")
    top = top.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]), ",").alias("common_prefixes"))
    return out.join(top, "g", "left").withColumn("common_prefixes", F.coalesce("common_prefixes", F.lit(""))).withColumnRenamed("g", group)


def mechanics(df: DataFrame, group: str, body: str = "body") -> DataFrame:
    """Contractions, dashes, semicolons, ellipses, and exclamation and question marks a mail."""
    rows = _filled(df, body).select(F.col(group).alias("g"), "_b")
    found = F.transform(F.regexp_extract_all("_b", F.lit(rf"(?i)\b(?:{'|'.join(CONTRACTIONS)})\b"), F.lit(0)), lambda c: F.lower(c))
    rows = rows.withColumn("c", found)
    has = lambda p: F.count_if(F.col("_b").rlike(p)) > F.count("*") * 0.1
    used = F.count_if(F.size("c") > 0)
    out = rows.groupBy("g").agg(
        (used > F.count("*") * 0.3).alias("uses_contractions"), F.round(used / F.count("*"), 2).alias("contraction_rate"),
        has("--|—|–").alias("uses_em_dash"), has(";").alias("uses_semicolons"), has(r"\.\.\.|…").alias("uses_ellipsis"),
        F.round(F.avg(T.occurrences(F.col("_b"), "!")), 2).alias("exclamation_rate"), F.round(F.avg(T.occurrences(F.col("_b"), "?")), 2).alias("question_rate"),
    )
    counts = rows.select("g", F.explode("c").alias("c")).groupBy("g", "c").count()
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("count"), "c"))).where("k <= 5")
    top = top.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]), ",").alias("common_contractions"))
    return out.join(top, "g", "left").withColumn("common_contractions", F.coalesce("common_contractions", F.lit(""))).withColumnRenamed("g", group)


def email_types(df: DataFrame, group: str, body: str = "body", audience: str = "audience") -> DataFrame:
    """The type of a group's mails by shares of status words, bullets, outreach and requests, with a confidence."""
    b = F.lower(F.coalesce(F.col(body), F.lit("")))
    status = b.rlike("status|update|progress|completed|in progress|blocked|milestone")
    outreach = b.rlike("reach out|reaching out|introduce|opportunity|connect|partnership")
    request = b.rlike(r"could you|can you|please|would you|need you to|request")
    bullets = F.coalesce(F.col(body), F.lit("")).rlike(r"(?m)^\s*[-*•]\s+")
    share = lambda c: F.avg(c.cast("int"))
    rows = df.groupBy(group).agg(
        share(status).alias("s"), share(outreach).alias("o"), share(request).alias("r"), share(bullets).alias("b"),
        share(F.col(audience) == "external").alias("x"), F.avg(F.length(b)).alias("mean_length"),
    )
    is_status, is_cold, is_request = (F.col("s") > 0.5) & (F.col("b") > 0.4), (F.col("o") > 0.4) & (F.col("x") > 0.5), F.col("r") > 0.5
    kind = F.when(is_status, "internal_status_update").when(is_cold, "cold_outreach").when(is_request, "request").otherwise("general")
    sure = F.when(is_status, F.least(F.lit(0.9), F.col("s") + 0.3 * F.col("b"))).when(is_cold, F.least(F.lit(0.85), F.col("o") + 0.2))
    sure = sure.when(is_request, F.least(F.lit(0.8), F.col("r"))).otherwise(F.lit(0.6))
    return rows.select(
        group, kind.alias("email_type"), F.round(sure, 4).alias("confidence"), F.floor(F.col("mean_length") * 0.5).alias("min_length"), F.floor(F.col("mean_length") * 1.5).alias("max_length")
    )


def all_measures(df: DataFrame, group: str) -> DataFrame:
    """The six measures in one row a group: rhythm, formatting, greetings, closings and signatures, subjects, mechanics.

    Each measure is a small table of a row a group, so joining them shuffles no mails.
    """
    pick = lambda rows, label: rows.where("is_primary").select(group, F.col(label).alias(f"primary_{label}"), F.col("ratio").alias(f"{label}_ratio"))
    parts = [rhythm(df, group), pick(greetings(df, group), "greeting"), pick(closings(df, group), "closing"), signature_blocks(df, group), subjects(df, group), mechanics(df, group)]
    out = formatting(df, group)
    for part in parts:
        out = out.join(part.drop(*(c for c in part.columns if c != group and c in out.columns)), group, "left")
    return out
