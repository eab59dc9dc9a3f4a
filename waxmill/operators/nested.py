"""Deeply nested records as related flat tables, by Dewey labels.

Each object of a document gets a label: one ordinal per step from the root (the field's place in the declared shape, then the
position in the stored array). A parent's label is the child's label cut off at the end, so links between the flat tables need
neither surrogate keys nor joins, and every task labels its own documents: nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Node:
    """A declared object: `many` where an array of them belongs. Nodes without a name are passed through but not returned."""

    name: str | None = None
    many: bool = False
    children: dict[str, Node] = field(default_factory=dict)
    fields: tuple[str, ...] = ()


NODE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("document", T.LongType()),
        T.StructField("schema_path", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("dewey", T.ArrayType(T.IntegerType())),
        T.StructField("parent_dewey", T.ArrayType(T.IntegerType())),
        T.StructField("ordinals", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _refuse(text: str) -> None:
    raise ValueError(text)


def parse_complete(text: str | None) -> object:
    """The value of one complete JSON text; a JSON string that itself holds JSON is read as that. None for anything else."""
    try:
        while isinstance(text, str):
            text = json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
            if isinstance(text, _Number):
                return None
        return text
    except (ValueError, RecursionError):
        return None


class _Number(str):
    """A number's text, kept apart from strings at the top of a document."""


def _one(value: object) -> dict | None:
    """The object, or the only object of an array of one; None for everything else."""
    while isinstance(value, list) and len(value) == 1:
        value = value[0]
    return value if isinstance(value, dict) else None


def walk(value: object, node: Node, at: tuple[int, ...], ordinals: tuple[int, ...], path: str) -> Iterator[tuple]:
    """(schema path, name, label, parent's label, ordinals, object) of each declared object below value."""
    stack = [(value, node, at, at, ordinals, path)]
    while stack:
        value, node, at, parent, ordinals, path = stack.pop()
        if node.many:
            items = [value] if isinstance(value, dict) else value if isinstance(value, list) else []
            found = [(x, (*at, i), (*ordinals, i)) for i, item in enumerate(items) if (x := _one(item)) is not None]
            path += "[]"
        else:
            found = [(x, at, ordinals)] if (x := _one(value)) is not None else []
        for x, label, numbers in found:
            if node.name:
                yield path, node.name, label, parent, numbers, x
            for place, (name, child) in enumerate(node.children.items()):
                if x.get(name) is not None:
                    stack.append((x[name], child, (*label, place), label, numbers, f"{path}.{name}"))


def _text(value: object) -> str | None:
    return value if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False)


def _labeller(shapes: list[tuple[str, Node]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.map_(pa.string(), pa.string())]
    wanted: dict[str, tuple[str, ...]] = {}

    def collect(node: Node) -> None:
        if node.name:
            wanted[node.name] = node.fields
        for child in node.children.values():
            collect(child)

    for _, node in shapes:
        collect(node)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=NODE_SCHEMA.fieldNames())

        for batch in batches:
            rows: list[tuple] = []
            key, document = batch.column(0), batch.column(1)
            for at, (name, shape) in enumerate(shapes):
                for i, text in enumerate(batch.column(at + 2)):
                    value = parse_complete(text.as_py())
                    if value is None:
                        continue
                    k, d = key[i].as_py(), document[i].as_py()
                    for path, node, dewey, parent, ordinals, x in walk(value, shape, (), (), name):
                        rows.append((k, d, path, node, dewey, parent, ordinals, [(f, _text(x.get(f))) for f in wanted[node]]))
                    if len(rows) >= 20_000:
                        yield flush(rows)
                        rows = []
            yield flush(rows)

    return label


def label_nodes(df: DataFrame, key: Column, shapes: dict[str, Node]) -> DataFrame:
    """One row for each declared object in the JSON columns of df (NODE_SCHEMA).

    key: the column that names the record; rows whose key is null are left out. document: a hash of the record's texts, so
    that two versions of one record don't mix. ordinals: the positions in the stored arrays alone, outermost first. values:
    the declared fields of the object as text (null where absent).

    An object where an array belongs is an array of one, and an array of one object where one object belongs is that object.
    Nulls and scalars yield no row but keep their position; undeclared fields are passed over, whatever their names; a text
    that isn't one complete JSON value (or is nested so deeply that it can't be read) yields nothing. Repeated rows yield
    repeated nodes.
    """
    texts = [F.col(name) for name in shapes]
    prepared = df.select(key.cast("string").alias("__key"), F.xxhash64(*texts).alias("__document"), *(t.cast("string").alias(f"__text{i}") for i, t in enumerate(texts))).filter(F.col("__key").isNotNull())
    return prepared.mapInArrow(_labeller(list(shapes.items())), NODE_SCHEMA)


def node_table(nodes: DataFrame, name: str, ordinals: tuple[str, ...], fields: tuple[str, ...] = ()) -> DataFrame:
    """The flat table of one declared node: key, document, dewey, parent_dewey, its ordinals by name and its fields as text."""
    picked = [F.get("ordinals", F.lit(i)).alias(o) for i, o in enumerate(ordinals)]
    return nodes.filter(F.col("node") == name).select("key", "document", "dewey", "parent_dewey", *picked, *(F.col("values").getItem(f).alias(f) for f in fields))
