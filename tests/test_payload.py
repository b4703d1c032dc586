import base64
import json

from pyspark.sql import functions as F

from scriptorium.operators import payload


def b64(text: str | bytes) -> str:
    return base64.urlsafe_b64encode(text.encode() if isinstance(text, str) else text).decode().rstrip("=")


def plain(text, **more):
    return {"mimeType": "text/plain", "body": {"data": b64(text)}, **more}


PAYLOADS = {
    "deep": {
        "headers": [{"name": "SUBJECT", "value": None}, {"name": "Subject", "value": "Re: x"}, {"name": "To", "value": "A <a@x.test>, b@x.test"}, {"name": "cc", "value": "A@x.test"}, {"name": "References", "value": "<1> <2>\t<3>"}],
        "parts": [{"mimeType": "multipart/alternative", "parts": [plain(""), {"mimeType": "text/plain", "body": {"data": b64(b"\xff\xfe\xff")}}, plain("grüß dich")]}, {"mimeType": "image/png", "filename": "a.png"}],
    },
    "lone": {"headers": {"name": "From", "value": "me@y.test"}, "parts": {"mimeType": "text/html", "parts": {"filename": "f", "mimeType": "x"}}, "body": {"data": b64("own")}},
    "bare": {"headers": None, "parts": None},
    "odd": {"headers": ["x", {"name": 3, "value": "v"}, {"value": "v"}], "body": "text", "parts": [None, "p", 5]},
}


def test_fields(spark):
    rows = [(k, json.dumps(v), "snip") for k, v in PAYLOADS.items()] + [("twice", json.dumps(json.dumps(PAYLOADS["lone"])), None), ("cut", json.dumps(PAYLOADS["lone"])[:-5], "s"), ("null", None, None), ("empty", "", None)]
    df = spark.createDataFrame(rows, "id string, payload string, snippet string")
    got = {r.id: r.p for r in df.select("id", payload.fields(F.col("payload"), F.col("snippet")).alias("p")).collect()}
    deep = got["deep"]
    assert (deep.body, deep.subject, deep.recipients, deep.refs, deep.attachments) == ("grüß dich", "Re: x", ["A@x.test", "a@x.test", "b@x.test"], 3, 1)
    assert (got["lone"].body, got["lone"].sender, got["lone"].attachments) == ("own", "me@y.test", 1) and got["twice"] == got["lone"]
    assert got["bare"].body == "snip" and got["odd"].body == "snip" and got["odd"].subject == ""
    assert [got[k].readable for k in ("cut", "null", "empty")] == [False] * 3 and got["cut"].body == "s" and got["null"].body == ""
    assert df.limit(0).select(payload.fields(F.col("payload"), F.col("snippet"))).collect() == []


def test_thread_position(spark):
    cases = [("Fwd: a", 3, True, "forward", 1), ("re: a", 0, False, "reply", 1), ("a", 4, False, "reply", 4), ("a", 0, True, "reply", 1), (None, 0, False, "initiating", 0)]
    df = spark.createDataFrame([c[:3] for c in cases], "s string, r int, i boolean")
    position, depth = payload.thread_position(F.col("s"), F.col("r"), F.col("i"))
    assert [tuple(r) for r in df.select(position, depth).collect()] == [c[3:] for c in cases]


def test_vector_text_and_ends(spark):
    df = spark.createDataFrame([("Plan", "> old\nnew line\nOn Monday Ann wrote:\nolder"), ("Re: Plan", "x" * 30), (None, None)], "s string, b string")
    assert [r[0] for r in df.select(payload.seek_text(F.col("s"), F.col("b"), 20)).collect()] == ["Plan\n\nnew line", "x" * 20 + "...", ""]
    ends = spark.createDataFrame([("Hi Ann,\ntext\nBest,\nJo",), ("one line",), ("",), (None,)], "r string")
    assert [tuple(r) for r in ends.select(*payload.reply_ends(F.col("r"))).collect()] == [("Hi Ann,", "Jo"), ("", ""), ("", ""), ("", "")]
