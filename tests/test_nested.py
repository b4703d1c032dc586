import json

from scriptorium.operators import nested

SCHEMA = "id string, payload string, path string, `record` int"


def links(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    layout = nested.layout_of(df, "payload")
    found = nested.shred(df, "id", "payload", layout).where("element <> '$'")
    return layout, sorted((r.record, r.element, r.parent_path, r.child_no) for r in found.collect())


def tree(depth):
    node = {"mimeType": "text/plain", "headers": [{"name": "n", "value": depth}], "parts": []}
    for _ in range(depth):
        node = {"mimeType": "multipart", "parts": [node]}
    return node


def test_tables_and_links(spark):
    payload = {"headers": [{"name": "A", "value": "1"}, None, {"name": "A", "value": "1"}], "body": {"size": 3}, "parts": [{"partId": "0", "body": {"size": 1}, "parts": {"partId": "0.0"}}]}
    layout, found = links(spark, [("a", json.dumps(payload), "x", 1), ("b", json.dumps(json.dumps(payload)), None, 2)])
    assert layout.tables == {"$", "headers", "parts"} and layout.inlined == {"body"}
    one = [("headers", "", 0), ("headers", "", 2), ("parts", "", 0), ("parts", "0", 0)]
    assert found == sorted((i, *x) for i in "ab" for x in one)


def test_defined_cases(spark):
    rows = [("n", None, None, 1), ("e", "", None, 1), ("b", "  ", None, 1), ("c", '{"parts": [', None, 1), ("s", '"text"', None, 1), ("d", json.dumps(tree(40)), None, 1), ("d", json.dumps(tree(40)), None, 1)]
    _, found = links(spark, rows)
    assert {f[0] for f in found} == {"d"} and len(found) == 2 * (40 + 1)
    assert links(spark, [])[1] == []


def test_deeper_than_the_parser(spark):
    deep = '{"a":' * 50_000 + "1" + "}" * 50_000
    value, n = nested.read_record(deep), 0
    while isinstance(value, dict):
        value, n = value["a"], n + 1
    assert (value, n) == (1, 50_000)
    assert nested._parse_deep('{"x": [1, "a,]}", {"y": null}], "z": {}}') == {"x": [1, "a,]}", {"y": None}], "z": {}}


def test_flat_tables_inline_and_avoid_clashes(spark):
    df = spark.createDataFrame([("a", json.dumps({"path": "p", "body": {"size": 1}, "parts": [{"path": "q", "record": True}]}))], "id string, payload string")
    flat = nested.flat_tables(df, "id", "payload")
    root = flat["$"].first()
    assert (root.path, root.path_, root.body_size) == ("", "p", "1")
    part = flat["parts"].first()
    assert (part.path, part.parent_path, part.path_, part.record_) == ("0", "", "q", "true")


def test_recursion_shared_and_singletons():
    edges = [("$", "a", 1, 0), ("$", "b", 1, 0), ("a", "c", 1, 0), ("b", "c", 1, 0), ("c", "x", 0, 0), ("b", "r", 1, 0), ("r", "r", 1, 0)]
    layout = nested.shared_inlining(edges)
    assert layout.tables == {"$", "c", "r"} and layout.inlined == {"a", "b"}
