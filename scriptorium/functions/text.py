"""Column expressions on texts; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-zA-Z]{2,}"
WORD = r"[\p{L}\p{N}_]+"


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")


def lines(text: Column) -> Column:
    """The lines of a text, without their carriage returns."""
    return F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n", -1)


def filled(items: Column) -> Column:
    """The stripped items that aren't empty."""
    return F.filter(F.transform(items, strip), lambda x: x != "")


def matches(text: Column, patterns: list[str], flags: str = "(?im)") -> Column:
    """Whether any pattern is found; null texts don't match."""
    return F.coalesce(text.rlike(flags + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def first_label(text: Column, labels: list[tuple[str, str]]) -> Column:
    """The label of the first pattern that is found, else null."""
    out = F
    for pattern, label in labels:
        out = out.when(text.rlike(pattern), F.lit(label))
    return out


def occurrences(text: Column, what: str) -> Column:
    """How often a plain string stands in a text."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")
