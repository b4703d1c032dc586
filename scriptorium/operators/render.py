"""Texts made from records: posts as Markdown, groups of mails as batches, replies by template.

Batches hold a bounded number of records each, numbered before they are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.profiles import numbered_within


def post_markdown(text: Column, likes: Column, comments: Column, date: Column, number: Column, total: Column) -> Column:
    head = F.concat(F.lit("### Post "), (number + 1).cast("string"), F.lit(" of "), total.cast("string"))
    return F.concat_ws(
        "\n", head, F.lit(""), F.concat(F.lit("**Engagement:** "), likes.cast("string"), F.lit(" likes, "), comments.cast("string"), F.lit(" comments")),
        F.concat(F.lit("**Date:** "), F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("Unknown"))), F.lit(""), F.lit("**Text:**"), F.lit("```"), F.coalesce(text, F.lit("")), F.lit("```"), F.lit("---"),
    )


def reply(p: dict[str, Column], subject: Column, quoted: Column) -> Column:
    """A reply by a profile's greeting, directness, warmth, authority and closing."""
    f = p["formality"]
    greeting = F.coalesce(F.nullif(p["typical_greeting"], F.lit("")), F.when(f >= 7, "Good afternoon,").when(f >= 5, "Hi,").otherwise("Hey"))
    closing = F.coalesce(F.nullif(p["typical_closing"], F.lit("")), F.when(f >= 7, "Best regards,").when(f >= 5, "Best,").otherwise("Thanks"))
    direct = p["directness"] >= 7
    s = F.lower(F.coalesce(subject, F.lit("")))
    update = F.when(direct, "Here's the update:").otherwise("I wanted to share an update on this.")
    answer = F.when(direct, "Quick answer:").when(p["warmth"] >= 6, "Happy to help with this.").otherwise("Here's what I can share:")
    other = F.when(direct, "Three things:").when(p["authority"] >= 7, "Here's my take:").otherwise("Thanks for reaching out.")
    body = F.when(s.contains("update"), update).when(s.contains("question") | F.coalesce(quoted, F.lit("")).contains("?"), answer).otherwise(other)
    body = F.when(p["contractions"], body).otherwise(F.replace(F.replace(body, F.lit("Here's"), F.lit("Here is")), F.lit("I'm"), F.lit("I am")))
    return F.concat_ws("\n", greeting, F.lit(""), body, F.lit(""), closing)


def batch_text(df: DataFrame, group: str, id_col: str, parts: list[str], most: int = 30) -> DataFrame:
    """(group, batch, n, text): all records of each group by id, `most` a batch, one block each with its whole texts.

    Records are numbered before they are gathered, so a group of any size makes more batches, not larger ones.
    """
    block = F.concat_ws("\n", F.concat(F.lit("## "), F.col(id_col).cast("string")), *(F.coalesce(F.col(c), F.lit("")) for c in parts))
    rows = df.select(F.col(group).alias("g"), F.col(id_col).alias("i"), block.alias("b")).groupBy("g", "i").agg(F.min("b").alias("b"))
    dealt = numbered_within(rows, "g", "i", "k").withColumn("batch", F.floor((F.col("k") - 1) / most).cast("int"))
    out = dealt.groupBy("g", "batch").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("k", "b"))).alias("l"))
    return out.select(F.col("g").alias(group), "batch", "n", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("text"))


def first_unread(df: DataFrame, id_col: str, read: DataFrame, most: int = 30) -> DataFrame:
    """The first records by id that were not read yet: a batch of a given size is what this is for."""
    return df.join(read.select(F.col("id").alias(id_col)).distinct(), id_col, "left_anti").dropDuplicates([id_col]).orderBy(id_col).limit(most)


def group_prompt(size: Column, spread_: Column, calibration: Column, metrics: Column, batch: Column) -> Column:
    """What a model is asked about a group: its size and make-up, how to judge, what was measured, and the mails."""
    part = lambda title, text: F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(f"# {title}\n"), text))
    head = F.concat(F.lit("Describe the way of writing of these "), size.cast("string"), F.lit(" mails."))
    return F.concat_ws("\n\n", head, part("Make-up", spread_), part("Calibration", calibration), part("Measured", metrics), part("Mails", batch))


def profile_markdown(p: dict[str, Column]) -> Column:
    """A profile as a section of a document; what is null is left out."""
    line = lambda title, c: F.concat(F.lit(f"- {title}: "), c.cast("string"))
    head = F.concat(F.lit("## "), F.coalesce(p["name"], F.lit("Unnamed")))
    return F.concat_ws("\n", head, F.nullif(p["description"], F.lit("")), *(line(k.replace("_", " "), p[k]) for k in p if k not in ("name", "description")))


def document(sections: DataFrame, order: str, section: str, title: str) -> DataFrame:
    """One row: the sections in order under a title; sections are profiles, which are few."""
    rows = sections.agg(F.array_sort(F.collect_list(F.struct(order, section))).alias("l"))
    return rows.select(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("l", lambda x: x[section]), "\n\n")).alias("text"))
