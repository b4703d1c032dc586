"""Mail fields out of the nested payload that mail servers deliver.

A payload nests parts to any depth, and a decoded part is bytes that may not be text, so it
is walked in Arrow-batched Python, once a row for all fields; nothing is shuffled.

Defined cases: null, empty and unreadable payloads have readable false and no header; a
lone object is a list of one; header names compare without case, and of several headers of
a name the first with a value counts; data that is no base64url or no UTF-8 is passed over;
repeated rows are read each; other columns are not touched.
"""

from __future__ import annotations

import base64
import binascii
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.session import ship

from scriptorium.functions import text as T
from scriptorium.operators.nested import read_record

_ADDRESS = re.compile(r"[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}")
FIELDS = (
    "readable boolean, body string, subject string, sender string, to string, cc string, recipients array<string>, refs int, in_reply_to boolean, attachments int"
)


def _list(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _objects(value) -> list[dict]:
    return [x for x in _list(value) if isinstance(x, dict)]


def _decoded(node: dict) -> str:
    body = node.get("body")
    data = body.get("data") if isinstance(body, dict) else None
    if not isinstance(data, str) or not data:
        return ""
    try:
        return base64.b64decode(data.replace("-", "+").replace("_", "/") + "=" * (-len(data) % 4), validate=True).decode()
    except (binascii.Error, ValueError):
        return ""


def _parts(node: dict) -> list[dict]:
    """All parts below a node, parents first, in their order."""
    out, todo = [], _objects(node.get("parts"))[::-1]
    while todo:
        part = todo.pop()
        out.append(part)
        todo += _objects(part.get("parts"))[::-1]
    return out


def read_fields(payload: str | None, snippet: str | None) -> tuple:
    """The FIELDS of one payload; the body is the first plain part that is not empty, else the payload's own, else the snippet."""
    node = read_record(payload) if payload else None
    if not isinstance(node, dict):
        return False, snippet or "", "", "", "", "", [], 0, False, 0
    headers: dict = {}
    for h in _objects(node.get("headers")):
        name, value = h.get("name"), h.get("value")
        if isinstance(name, str) and isinstance(value, str):
            headers.setdefault(name.lower(), []).append(value)
    first = lambda name: next((v for v in headers.get(name, []) if v), "")
    parts = _parts(node)
    body = next((t for p in parts if p.get("mimeType") == "text/plain" and (t := _decoded(p))), "") or _decoded(node) or snippet or ""
    found = sorted({a for name in ("to", "cc", "bcc") for v in headers.get(name, []) for a in _ADDRESS.findall(v)})
    refs = len(first("references").split())
    return True, body, first("subject"), first("from"), first("to"), first("cc"), found, refs, bool(first("in-reply-to")), sum(bool(p.get("filename")) for p in parts)


def fields(payload: Column, snippet: Column) -> Column:
    """read_fields() as a struct column."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    ship(SparkSession.active())

    @F.pandas_udf(FIELDS)
    def udf(payloads: pd.Series, snippets: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_fields(p, s) for p, s in zip(payloads, snippets)], columns=names)

    return udf(payload, snippet)


def with_fields(df: DataFrame) -> DataFrame:
    """Adds `mail`: the payload's fields, what it lacks from the flat columns body, subject, from_addr, to_addr and snippet.

    A flat body counts even if it is empty; the payload is read where there is none.
    """
    rows = df.withColumn("_p", fields(F.col("payload"), F.col("snippet")))
    own = lambda name, flat: F.coalesce(F.nullif(F.col(f"_p.{name}"), F.lit("")), F.col(flat), F.lit(""))
    flat_to = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce("to_addr", F.lit("")), F.lit(T.ADDRESS), F.lit(0))))
    return rows.withColumn("mail", F.struct(
        F.coalesce("body", "_p.body", "snippet", F.lit("")).alias("body"), own("subject", "subject").alias("subject"), own("sender", "from_addr").alias("sender"),
        F.when(F.size("_p.recipients") > 0, F.col("_p.recipients")).otherwise(flat_to).alias("recipients"), F.coalesce(F.col("_p.cc") != "", F.lit(False)).alias("has_cc"),
        F.col("_p.refs").alias("refs"), F.col("_p.in_reply_to").alias("in_reply_to"), F.col("_p.attachments").alias("attachments"),
    )).drop("_p")


def thread_position(subject: Column, refs: Column, in_reply_to: Column) -> tuple[Column, Column]:
    """Position in the thread and its depth: forwards by subject, replies by references, the reply header or the subject."""
    low = F.lower(T.strip(F.coalesce(subject, F.lit(""))))
    forward, answer = low.rlike("^(fwd:|fw:)"), low.rlike("^re:")
    headed = (refs > 0) | in_reply_to
    position = F.when(forward, "forward").when(headed | answer, "reply").otherwise("initiating")
    return position, F.when(forward, 1).when(headed, F.greatest(refs, F.lit(1))).when(answer, 1).otherwise(0)


def seek_text(subject: Column, body: Column, most: int = 2000) -> Column:
    """A mail's text for a vector model: own lines up to the quotation, under the subject unless that is a reply's.

    The model's limit is a parameter: longer texts end in three dots.
    """
    lines = T.lines(F.coalesce(body, F.lit("")))
    kept = F.filter(lines, lambda x: ~T.strip(x).startswith(">"))
    stop = F.array_position(F.transform(kept, lambda x: x.contains("wrote:") & x.contains("On ")), True)
    own = F.when(stop > 0, F.slice(kept, F.lit(1), (stop - 1).cast("int"))).otherwise(kept)
    text = T.strip(F.array_join(own, "\n"))
    subject = F.coalesce(subject, F.lit(""))
    text = F.when((subject != "") & ~F.lower(subject).startswith("re:"), F.concat(subject, F.lit("\n\n"), text)).otherwise(text)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


# First lines and last lines of replies.
REPLY_OPENS = r"(?i)^(?:(?:Hi|Hey|Hello|Dear|Good morning|Good afternoon|Good evening|Thanks|Thank you)\b)"
REPLY_ENDS = (
    r"(?i)^(?:(?:Best|Thanks|Thank you|Cheers|Regards|Sincerely|Best regards|Kind regards|Warm regards)|(?:Talk soon|Looking forward|Let me know|Hope this helps)|[-–—]?\s*[A-Z][a-z]+$)"
)


def reply_ends(reply: Column) -> tuple[Column, Column]:
    """Greeting and closing of a reply: its first line, and the last of its final three, where they look like one; '' without."""
    lines = T.filled(T.lines(F.coalesce(reply, F.lit(""))))
    first = F.get(lines, F.lit(0))
    last = F.reverse(F.slice(lines, -F.least(F.size(lines), F.lit(3)), F.lit(3)))
    closing = F.when(F.size(lines) > 1, F.get(F.filter(last, lambda x: x.rlike(REPLY_ENDS)), F.lit(0)))
    return F.coalesce(F.when(first.rlike(REPLY_OPENS), first), F.lit("")), F.coalesce(closing, F.lit(""))
