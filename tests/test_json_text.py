import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.operators import json_text as J


@pytest.mark.parametrize("text,want", [('{"key": "value"', '{"key": "value"}'), ('["a", "b"', '["a", "b"]'), ('{"arr": [1, 2', '{"arr": [1, 2]}'), ('{"a": "x', '{"a": "x"}')])
def test_close(text, want):
    assert J.close(text) == want


def test_parse():
    assert J.parse('{"key": "value",}')["repaired"] and not J.parse('{"key": "value",}', strict=True)["success"]
    assert J.parse('```json\n{"key": "value"}\n```')["data"] == '{"key": "value"}'
    assert not J.parse("This is not JSON at all")["success"] and not J.parse(None)["success"] and not J.parse("")["success"]
    assert J.extract('see {"a": "}"} and more') == '{"a": "}"}'
    assert json.loads(J.escape_quotes('{"a": "say "hi" now"}')) == {"a": 'say "hi" now'}


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(), x, max_size=3), max_leaves=10).filter(lambda v: isinstance(v, (dict, list))))
def test_round_trip(value):
    text = json.dumps(value)
    assert json.loads(J.extract(f"here: {text} end")) == value
    assert json.loads(J.close(text)) == value


def test_merge():
    base = {"a": "", "b": {"c": None, "d": 1}, "e": []}
    assert J.merge(base, {"a": "x", "b": {"c": 2, "d": 3}, "e": [1], "f": 4}) == {"a": "x", "b": {"c": 2, "d": 1}, "e": [1], "f": 4}


def test_columns(spark):
    df = spark.createDataFrame([('{"a": 1,}',), (None,), ("",)], "t string")
    assert [r.s for r in df.select(J.parsed(F.col("t")).alias("p")).select(F.col("p.success").alias("s")).collect()] == [True, False, False]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(J.batch_errors(F.lit('{"samples": [{"id": "1", "persona": "p"}]}'))) == ""
    assert one(J.batch_errors(F.lit('{"samples": []}'))) == "no samples" and one(J.batch_errors(F.lit("x"))) == "no samples"
    assert one(J.version(F.lit('{"schema_version": "3"}'))) == "3" and one(J.version(F.lit("{}"))) == "1.0"
    assert one(J.merged(F.lit("{bad"), F.lit('{"a": 1}'))) == '{"a": 1}'
