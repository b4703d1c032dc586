import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import tokens
from scriptorium.llm.transducer import Encoder, Utf8, read_ranks

DATA = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module")
def ours():
    return Encoder(DATA, P.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(DATA), special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])))
def test_any_text(ours, theirs, text):
    ids = ours.encode(text)
    assert ids == theirs.encode_ordinary(text) and ours.decode(ids) == text and ours.count(text) == len(ids)


def test_hard_texts(ours, theirs):
    rng = random.Random(3)
    parts = ["a", "ab", " ", "   ", "é", "日本", "🇩🇪", "\n", "\r\n", "the", "ing", "123", "_", "=====", "\t", "ﬁ", "'s", "<|endoftext|>"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        assert ours.encode(text) == theirs.encode_ordinary(text)
    long = "abcdefghij" * 50_000
    assert ours.encode(long) == theirs.encode_ordinary(long)


def test_stream(ours):
    text = "héllo 日本 🇩🇪!"
    ids = ours.encode(text)
    pieces = list(ours.stream(ids))
    assert "".join(pieces) == text and len(pieces) > 3


@settings(max_examples=500, deadline=None)
@given(st.binary(max_size=30), st.integers(0, 30))
def test_utf8(data, cut):
    machine = Utf8()
    assert machine.feed(data[:cut]) + machine.feed(data[cut:]) + machine.close() == data.decode("utf-8", "replace")


def test_ids_of_rows(spark, theirs):
    rows = [(1, "Hello there"), (1, "Hello there"), (2, None), (3, ""), (4, "  ")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumnRenamed("doc_id", "ids")
    got = sorted((r.id, r.ids) for r in tokens.token_ids(df, "ids", "text", tokens.public(spark)).collect())
    assert got == sorted((i, theirs.encode_ordinary(t or "")) for i, t in rows)
    assert tokens.token_ids(df.limit(0), "ids", "text", tokens.public(spark)).collect() == []
    assert sorted(r.n_tokens for r in tokens.with_token_count(df, "text", tokens.public(spark)).collect()) == [0, 0, 2, 2, 2]
