"""Queries on personal items in emails."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import personal
from scriptorium.session import cut
from scriptorium.tables import spread, table

FIELDS = ["body", "subject", "to_addr"]
#: The setting that holds the key of the replacements; without it, each process draws a key of its own.
KEY_SETTING = "spark.scriptorium.replacement.key"
_DRAWN = secrets.token_bytes(32)


def _key(spark: SparkSession) -> bytes:
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else _DRAWN


def _names(spark: SparkSession, directory: str) -> DataFrame:
    email = spread(table(spark, directory, "email").select("from_addr", "to_addr"))
    addresses = email.select(F.explode(F.array("from_addr", "to_addr")).alias("address"))
    return cut(personal.learn_names(addresses, table(spark, directory, "given_names")))


def _email(spark: SparkSession, directory: str) -> DataFrame:
    return spread(table(spark, directory, "email").select("id", *FIELDS))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """The distinct personal items of each email."""
    found = personal.items(_email(spark, directory), "id", FIELDS, _names(spark, directory))
    return found.select("id", "field", "kind", "found_text").distinct()


def p2_placeholders(spark: SparkSession, directory: str) -> DataFrame:
    """The emails with typed placeholders."""
    return personal.replaced(_email(spark, directory), FIELDS, _names(spark, directory), _key(spark))


def p2_surrogates(spark: SparkSession, directory: str) -> DataFrame:
    """The emails with surrogates, different ones for different items."""
    email, names = _email(spark, directory), _names(spark, directory)
    salts = cut(personal.collisions(personal.items(email, "id", FIELDS, names), _key(spark)))
    return personal.replaced(email, FIELDS, names, _key(spark), "surrogate", salts)


def p2_distinct(spark: SparkSession, directory: str) -> DataFrame:
    """For each kind how many surrogates two items share."""
    found = cut(personal.items(_email(spark, directory), "id", FIELDS, _names(spark, directory)))
    return personal.shared_surrogates(found, _key(spark), personal.collisions(found, _key(spark))).select("kind", "shared")


QUERIES = {"p2_found": p2_found, "p2_placeholders": p2_placeholders, "p2_surrogates": p2_surrogates, "p2_distinct": p2_distinct}

#: Different items must have different surrogates.
ORACLES = {"p2_distinct": "SELECT unnest(['address', 'email', 'id_number', 'name', 'phone']) AS kind, 0 AS shared"}
