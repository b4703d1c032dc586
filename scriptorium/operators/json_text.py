"""JSON held in text: cut out of other text, repaired, checked, merged.

The scans need a state from character to character, which no built-in has, so they are
Arrow-batched Python over single rows. Null and empty texts give a failure without data.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.session import ship

from scriptorium.functions.text import strip

_FENCED = re.compile(r"```(?:json)?\s*\n?(.*?)```", re.S)
_COMMA = re.compile(r",(\s*[}\]])")
_MARKS = re.compile(r'["\\{}\[\]]')


def _marks(text: str, start: int = 0) -> Iterator[tuple[int, str]]:
    """The brackets and quotes that count, strings' contents aside; a quote is given as it opens and closes."""
    inside, skip = False, -1
    for m in _MARKS.finditer(text, start):
        i, c = m.start(), m.group()
        if i == skip:
            continue
        if c == "\\":
            if inside:
                skip = i + 1
        elif c == '"':
            inside = not inside
            yield i, c
        elif not inside:
            yield i, c


def extract(text: str) -> str:
    """The JSON part: the first fenced block that begins with a bracket, else from the first bracket to its partner, else to the end."""
    text = text.strip()
    for block in _FENCED.findall(text):
        if block.strip()[:1] in ("{", "["):
            return block.strip()
    text = text.removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return text
    opens, closes = (text[start], "}" if text[start] == "{" else "]")
    depth = 0
    for i, c in _marks(text, start):
        depth += (c == opens) - (c == closes)
        if depth == 0 and c == closes:
            return text[start : i + 1]
    return text[start:]


def drop_commas(text: str) -> str:
    return _COMMA.sub(r"\1", text)


def close(text: str) -> str:
    """The text with an open string closed, then all open arrays, then all open objects."""
    quotes, square, curly = 0, 0, 0
    for _, c in _marks(text):
        quotes += c == '"'
        square += (c == "[") - (c == "]")
        curly += (c == "{") - (c == "}")
    return text + '"' * (quotes % 2) + "]" * max(0, square) + "}" * max(0, curly)


def escape_quotes(text: str) -> str:
    """Quotes inside a string that no structural mark follows get a backslash."""
    out, inside, i = [], False, 0
    while i < len(text):
        c = text[i]
        if inside and c == "\\":
            out.append(text[i : i + 2])
            i += 2
            continue
        if c == '"':
            if inside and not re.match(r"\s*(?:[:,}\]]|$)", text[i + 1 :]):
                out.append('\\"')
                i += 1
                continue
            inside = not inside
        out.append(c)
        i += 1
    return "".join(out)


def repair(text: str) -> str:
    return close(drop_commas(extract(text)))


def _loads(text: str):
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def parse(text: str | None, strict: bool = False) -> dict:
    """success, data (JSON text), error, repaired and extracted: as it is, then without stray commas, then closed."""
    if not text:
        return {"success": False, "data": None, "error": "empty", "repaired": False, "extracted": None}
    found = extract(text)
    ok, value = _loads(found)
    repaired = False
    if not ok and not strict:
        repaired = True
        fixed = drop_commas(found)
        ok, value = _loads(fixed)
        if not ok:
            ok, value = _loads(close(fixed))
    data = json.dumps(value, ensure_ascii=False, sort_keys=True) if ok else None
    return {"success": ok, "data": data, "error": None if ok else "unreadable", "repaired": ok and repaired, "extracted": found}


def parsed(text: Column, strict: bool = False) -> Column:
    """parse() as a struct column."""
    ship(SparkSession.active())

    @F.pandas_udf("success boolean, data string, error string, repaired boolean, extracted string")
    def udf(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t, strict) for t in texts], columns=["success", "data", "error", "repaired", "extracted"])

    return udf(text)


def is_empty(value) -> bool:
    return value is None or (isinstance(value, str) and not value.strip()) or value in ([], {})


def merge(base, overlay):
    """The base with the overlay's values where the base has none; objects are merged field by field."""
    if isinstance(base, dict) and isinstance(overlay, dict):
        return {k: merge(base.get(k), overlay.get(k)) for k in {**base, **overlay}}
    return overlay if is_empty(base) and not is_empty(overlay) else base


def _texts(function: Callable[[str | None, str | None], str | None]):
    @F.pandas_udf("string")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([function(x, y) for x, y in zip(a, b)], dtype=object)

    return udf


def merged(base: Column, overlay: Column) -> Column:
    """merge() of two columns of JSON text; one that is unreadable counts as empty."""
    ship(SparkSession.active())

    def both(a, b):
        value = merge(_loads(a)[1] if a else None, _loads(b)[1] if b else None)
        return None if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)

    return _texts(both)(base, overlay)


def batch_errors(data: Column) -> Column:
    """Why a batch's JSON text is no analysis: '' where it has samples, each with id and persona."""
    schema = "samples array<struct<id string, persona string>>"
    rows = F.from_json(data, schema)["samples"]
    bad = F.exists(rows, lambda x: x.isNull() | (F.coalesce(x["id"], F.lit("")) == "") | (F.coalesce(x["persona"], F.lit("")) == ""))
    return F.when(F.coalesce(F.size(rows), F.lit(-1)) < 1, "no samples").when(bad, "sample without id or persona").otherwise("")


def version(data: Column) -> Column:
    """The schema version that a JSON text states, else 2.0 where it has a voice section, else 1.0."""
    stated = F.get_json_object(data, "$.schema_version")
    return F.coalesce(stated, F.when(F.get_json_object(data, "$.voice_fingerprint").isNotNull(), "2.0"), F.lit("1.0"))


def migrate(personas: DataFrame) -> DataFrame:
    """Profiles of the first schema as flat columns of the second; what the first lacks gets its defaults."""
    c = lambda name: F.col(f"characteristics.{name}")
    uses = c("uses_contractions")
    return personas.select(
        "persona_id", F.lit("2.0").alias("schema_version"), *(F.coalesce(c(s), F.lit(5)).alias(s) for s in ("formality", "warmth", "authority", "directness")),
        F.when(F.coalesce(uses, F.lit(False)), 0.5).otherwise(0.0).alias("contraction_rate"),
        F.coalesce(c("typical_greeting"), F.lit("Hi {name},")).alias("greeting"), F.coalesce(c("typical_closing"), F.lit("Best,")).alias("closing"),
    )


def retry_prompt(prompt: Column, error: Column) -> Column:
    """The prompt again, with what was wrong with the answer and what form it is to have."""
    return F.concat(
        prompt, F.lit("\n\nThe last answer was no valid JSON: "), F.coalesce(error, F.lit("unknown error")), F.lit("\nAnswer with one JSON object only: no text around it, no comma before a closing bracket, all brackets closed.")
    )


#: The sections of a profile, each with the fields it is to have.
SECTIONS = {"voice": ["formality", "warmth", "authority", "directness"], "opening": ["typical_greeting"], "closing": ["typical_closing"], "mechanics": ["uses_contractions"]}


def structure_warnings(data: Column, sections: dict[str, list[str]] = SECTIONS) -> Column:
    """Sections that a profile's JSON text lacks, and fields missing in those it has."""
    out = []
    for name, fields in sections.items():
        whole = F.get_json_object(data, f"$.{name}")
        out.append(F.when(whole.isNull(), F.lit(f"no {name}")))
        out += [F.when(whole.isNotNull() & (F.coalesce(strip(F.get_json_object(data, f"$.{name}.{f}")), F.lit("")) == ""), F.lit(f"no {name}.{f}")) for f in fields]
    return F.array_compact(F.array(*out))


def completed(data: Column, sections: dict[str, list[str]] = SECTIONS) -> tuple[Column, int]:
    """How many of all fields of the sections are filled, and how many there are."""
    filled = [F.coalesce(strip(F.get_json_object(data, f"$.{n}.{f}")) != "", F.lit(False)).cast("int") for n, fs in sections.items() for f in fs]
    return sum(filled[1:], filled[0]), len(filled)


def with_metrics(answers: DataFrame, metrics: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Answers of a model with the measured fields written over theirs; what was not measured stays as answered."""
    held = metrics.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    rows = answers.join(held, key, "left")
    return rows.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in answers.columns))


def merged_examples(examples: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """Lists of examples (text, why, context) with the notes of the same place in another list where the example has none."""
    a = examples.select(key, F.posexplode("examples").alias("pos", "e"))
    b = notes.select(key, F.posexplode("notes").alias("pos", "n"))
    pick = lambda f: F.coalesce(F.nullif(strip(F.col(f"e.{f}")), F.lit("")), F.col(f"n.{f}")).alias(f)
    return a.join(b, [key, "pos"], "left").select(key, "pos", "e.text", pick("why"), pick("context"))


def example_bank(samples: DataFrame, group: str, most: int = 5, least: float = 0.85) -> DataFrame:
    """(group, rank, id, confidence): each group's surest samples, as an example bank holds them; ties go by id."""
    rows = samples.where(F.col("confidence") >= least)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("confidence"), "id")))
    return ranked.where(F.col("rank") <= most).select(group, "rank", "id", "confidence")


def with_sources(bank: DataFrame, names: DataFrame, mails: DataFrame, group: str, longest: int = 1000) -> DataFrame:
    """A bank's examples with their profile's name and their mail's text, shortened as an example is."""
    return bank.join(names, group).join(mails, "id").select(*bank.columns, "name", F.substring(F.coalesce("body", F.lit("")), 1, longest).alias("example"))
