"""Nested records to related flat tables by shared inlining.

The schema graph of the JSON column is read from all records: an element is the name
of the field that holds it, an edge a field of an element. An element of whose fields half
or more are fields of a repeated element below it (as the root of a mail tree is formed
like its parts) is of that element's type. Then, over the types,

* an object that only ever stands once below one type is inlined: its leaves become
  columns of the row above it;
* an element that repeats, is below several types or below itself gets a table of its
  own, whose rows hold the key of the row above them.

The walk is Arrow-batched Python, as no built-in expression descends to any depth.
Records are independent, so nothing is shuffled but the edge counts.

Defined cases: null, empty, blank and unreadable records give no row; a record encoded
as JSON text again is decoded as often as needed; a lone object or scalar where other
records hold a list counts as a list of one; a null list or a null item has no row, but
its place is counted; scalars in a list get a row with the column `value`; scalars are
kept as text (true/false/number as JSON writes them). Repeated ids give repeated rows,
which the caller may drop by key. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import cut, ship

ROOT = "$"
#: The graph is held by the driver; more edges than this are a sign of data used as field names.
MAX_EDGES = 20_000

_EDGE_SCHEMA = "element string, field string, seen bigint, objects bigint, lists bigint, scalars bigint, most bigint, keys string"
_ROW_SCHEMA = "record string, element string, path string, parent_path string, parent_element string, child_no int, leaves map<string,string>"
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s{}\[\]:,"]+', re.S)


def _parse_deep(text: str):
    """JSON without recursion, for records nested deeper than the parser's stack."""
    stack: list = []
    out: list = []
    key = None
    keys: list = []
    for token in _TOKEN.findall(text):
        if token in "{[":
            value = {} if token == "{" else []
        elif token in "}]":
            stack.pop()
            key = keys.pop()
            continue
        elif token == ",":
            continue
        elif token == ":":
            key = out.pop()
            continue
        else:
            value = json.loads(token)
            if stack and isinstance(stack[-1], dict) and key is None:
                out.append(value)
                continue
        if not stack:
            root = value
        elif isinstance(stack[-1], dict):
            stack[-1][key] = value
        else:
            stack[-1].append(value)
        if token in "{[":
            stack.append(value)
            keys.append(None)
        key = None
    if stack:
        raise ValueError("cut off")
    return root


def read_record(text: str | None):
    """The value of a JSON text, decoded again while it is text; None if unreadable."""
    value = text
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except RecursionError:
            try:
                value = _parse_deep(value)
            except (ValueError, IndexError, UnboundLocalError):
                return None
        except ValueError:
            return None
    return value


def _scalar(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _objects(value) -> list[tuple[str, dict]]:
    """All (element, object) of a record, its root being ROOT."""
    stack, out = [(ROOT, value)], []
    while stack:
        name, node = stack.pop()
        if isinstance(node, list):
            stack.extend((name, x) for x in node)
        elif isinstance(node, dict):
            out.append((name, node))
            stack.extend((k, v) for k, v in node.items() if isinstance(v, (dict, list)))
    return out


def schema_edges(df: DataFrame, json_col: str) -> DataFrame:
    """One row per (element, field): how often it holds objects, lists and scalars, and the longest list."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = defaultdict(lambda: [0, 0, 0, 0, 0])
        for batch in batches:
            for text in batch["doc"]:
                for name, node in _objects(read_record(text)):
                    for key, value in node.items():
                        count = seen[name, key]
                        count[0] += 1
                        if isinstance(value, dict):
                            count[1] += 1
                            count[4] = max(count[4], 1)
                        elif isinstance(value, list):
                            count[2] += 1
                            count[4] = max(count[4], len(value))
                            count[1] += any(isinstance(x, dict) for x in value)
                        elif value is not None:
                            count[3] += 1
        yield pd.DataFrame(
            [(e, f, *c, None) for (e, f), c in seen.items()],
            columns=["element", "field", "seen", "objects", "lists", "scalars", "most", "keys"],
        )

    ship(df.sparkSession)
    found = df.select(F.col(json_col).cast("string").alias("doc")).where("doc is not null").mapInPandas(edges, _EDGE_SCHEMA)
    return found.groupBy("element", "field").agg(
        *(F.sum(c).alias(c) for c in ("seen", "objects", "lists", "scalars")), F.max("most").alias("most")
    )


@dataclass
class Layout:
    """Which fields get a table, which are inlined, which are leaves, by type."""

    tables: set = field(default_factory=set)
    inlined: set = field(default_factory=set)
    leaves: dict = field(default_factory=dict)


def shared_inlining(edges: list[tuple[str, str, int, int]]) -> Layout:
    """The layout of a schema graph of edges (element, field, objects, lists)."""
    fields: dict = defaultdict(set)
    nested: dict = defaultdict(set)
    repeated: set = set()
    scalar: dict = defaultdict(set)
    for element, name, objects, lists in edges:
        fields[element].add(name)
        if objects or lists:
            nested[element].add(name)
        else:
            scalar[element].add(name)
        if lists:
            repeated.add(name)
    same = {e: e for e in {*fields, *(n for s in nested.values() for n in s)}}
    for element in sorted(fields):
        for child in sorted(nested[element] & repeated):
            if element != child and child in nested[child] and 2 * len(fields[element] & fields[child]) >= len(fields[element]):
                same[element] = child
    parents: dict = defaultdict(set)
    for element, children in nested.items():
        for child in children:
            parents[child].add(same[element])

    def below(name: str) -> set:
        out: set = set()
        todo = [name]
        while todo:
            for child in nested[todo.pop()] - out:
                out.add(child)
                todo.append(child)
        return out

    layout = Layout(tables={ROOT})
    for child in parents:
        own = child in repeated or len(parents[child]) > 1 or child in below(child)
        (layout.tables if own else layout.inlined).add(child)

    def leaves(element: str, prefix: str, out: list) -> list:
        out += [prefix + f for f in sorted(scalar[element])]
        for child in sorted(nested[element] & layout.inlined):
            leaves(child, f"{prefix}{child}_", out)
        return out

    layout.leaves = {t: leaves(t, "", []) for t in layout.tables}
    return layout


def layout_of(df: DataFrame, json_col: str) -> Layout:
    """The layout from the schema graph of all records; only the graph reaches the driver."""
    edges = schema_edges(df, json_col).select("element", "field", "objects", "lists").limit(MAX_EDGES + 1).collect()
    if len(edges) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} distinct fields: field names hold data")
    return shared_inlining([tuple(e) for e in edges])


def shred(df: DataFrame, id_col: str, json_col: str, layout: Layout) -> DataFrame:
    """All rows of all tables: record, element, path, parent_path, parent_element, child_no, leaves.

    `path` joins the 0-based places from the root by dots; '' is the root. A row's key is
    (record, element, path), its foreign key (record, parent_element, parent_path).
    """
    tables, inlined = layout.tables, layout.inlined

    def row_leaves(node: dict, prefix: str, out: dict, held: list) -> None:
        for key, value in node.items():
            if key in tables and isinstance(value, (dict, list)):
                held.append((key, value))
            elif isinstance(value, dict) and key in inlined:
                row_leaves(value, f"{prefix}{key}_", out, held)
            elif key in tables and value is not None:
                held.append((key, value))
            elif value is not None:
                out[prefix + key] = _scalar(value)

    def walk(record: str, value, out: list) -> None:
        todo = [(ROOT, "", None, None, 0, value)]
        while todo:
            element, path, parent, parent_element, number, node = todo.pop()
            leaves: dict = {}
            held: list = []
            if isinstance(node, dict):
                row_leaves(node, "", leaves, held)
            else:
                leaves["value"] = _scalar(node)
            out.append((record, element, path, parent, parent_element, number, leaves))
            for key, child in held:
                for i, item in enumerate(child if isinstance(child, list) else [child]):
                    if item is not None:
                        todo.append((key, f"{path}.{i}" if path else str(i), path, element, i, item))

    columns = ["record", "element", "path", "parent_path", "parent_element", "child_no", "leaves"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list = []
            for record, text in zip(batch["record"], batch["doc"]):
                value = read_record(text)
                for item in value if isinstance(value, list) else [value]:
                    if item is not None:
                        walk(record, item, out)
            yield pd.DataFrame(out, columns=columns)

    ship(df.sparkSession)
    source = df.select(F.col(id_col).cast("string").alias("record"), F.col(json_col).cast("string").alias("doc"))
    return source.where("doc is not null").mapInPandas(rows, _ROW_SCHEMA)


def flat_tables(df: DataFrame, id_col: str, json_col: str, layout: Layout | None = None, names: list[str] | None = None) -> dict[str, DataFrame]:
    """One frame per table of the layout, or per name given, its leaves as string columns.

    For more than one table the records are shredded once, to a checkpoint that all read.
    """
    layout = layout or layout_of(df, json_col)
    wanted = sorted(layout.tables) if names is None else names
    rows = shred(df, id_col, json_col, layout)
    if len(wanted) > 1:
        rows = cut(rows.where(F.col("element").isin(wanted)))
    keys = ["record", "path", "parent_element", "parent_path", "child_no"]
    out = {}
    for name in wanted:
        taken = {k.lower() for k in keys}
        columns = []
        own = layout.leaves.get(name, [])
        for leaf in [*own, *([] if name == ROOT or "value" in own else ["value"])]:
            alias = leaf
            while alias.lower() in taken:
                alias += "_"
            taken.add(alias.lower())
            columns.append(F.col("leaves")[leaf].alias(alias))
        out[name] = rows.where(F.col("element") == name).select(*keys, *columns)
    return out
