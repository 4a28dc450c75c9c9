"""Rows of JSON text as columns: which keys there are, in the order in which they first appear, and what types fit them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.operators.clean import normal_name, unique_names

FILE_ORDER = "__file_order"  # a file's own row order: file, split, and place within the split
_SEEN = "path string, type string, file string, split long, place long, nth int"
_NUMBERS = ["bigint", "decimal", "double"]
_SPARK = {
    "null": T.StringType(), "boolean": T.BooleanType(), "bigint": T.LongType(), "decimal": T.DecimalType(38, 0), "double": T.DoubleType(),
    "string": T.StringType(),
}


def flatten(df: DataFrame, hidden: int = 0) -> DataFrame:
    """Nested objects as ``parent_child`` columns with normal, unique names; lists stay whole. The last ``hidden`` columns
    stay as they are. Columns are taken by place, so keys that differ only in case are told apart."""
    flat, paths = _leaves(df, hidden)
    return flat.toDF(*unique_names([normal_name(".".join(p)) for p in paths]), *df.columns[len(df.columns) - hidden :])


def _leaves(df: DataFrame, hidden: int) -> tuple[DataFrame, list[list[str]]]:
    shown = len(df.columns) - hidden
    paths = [[c] for c in df.columns[:shown]]
    flat = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    while any(isinstance(f.dataType, T.StructType) for f in flat.schema.fields[: len(paths)]):
        fields = flat.schema.fields
        opened, items = [], []
        for path, f in zip(paths, fields):
            nested = isinstance(f.dataType, T.StructType)
            opened += [[*path, inner.name] for inner in f.dataType.fields] if nested else [path]
            items.append(f"{f.name}.*" if nested else f.name)
        flat = flat.select(*items, *[f.name for f in fields[len(paths) :]])
        paths = opened
        flat = flat.toDF(*[f"c{i}" for i in range(len(flat.columns))])
    return flat, paths


def merged(a, b):
    """The narrowest type that holds both. Types are names, ["array", item] or ["struct", [[key, type], …]]."""
    if a == b or b == "null":
        return a
    if a == "null":
        return b
    if a in _NUMBERS and b in _NUMBERS:
        return max(a, b, key=_NUMBERS.index)
    if isinstance(a, list) and isinstance(b, list) and a[0] == b[0]:
        if a[0] == "array":
            return ["array", merged(a[1], b[1])]
        fields = dict(a[1])
        for key, kind in b[1]:
            fields[key] = merged(fields.get(key, "null"), kind)
        return ["struct", [[k, t] for k, t in fields.items()]]
    return "string"


def _type(value) -> object:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "bigint" if -(1 << 63) <= value < 1 << 63 else "decimal" if abs(value) < 10**38 else "double"
    if isinstance(value, float):
        return "double"
    if isinstance(value, list):
        kind: object = "null"
        for item in value:
            kind = merged(kind, _type(item))
        return ["array", kind]
    if isinstance(value, dict):
        return ["struct", [[k, _type(v)] for k, v in value.items()]]
    return "string"


def _walk(record: dict, path: list[str]) -> Iterator[tuple[list[str], object]]:
    for key, value in record.items():
        if isinstance(value, dict):
            yield from _walk(value, [*path, key])
        else:
            yield [*path, key], _type(value)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every key path and type of a task's records, once, with the first place it is at; an empty type for what is no object."""
    first: dict[tuple[str, str], tuple] = {}
    shapes: dict[str, str] = {}
    for batch in batches:
        for file, split, place, text in zip(*[c.to_pylist() for c in batch.columns]):
            try:
                record = json.loads(text)
                leaves = list(_walk(record, [])) if isinstance(record, dict) else [([], "")]
            except ValueError:
                leaves = [([], "")]
            for nth, (path, kind) in enumerate(leaves):
                name = shapes.setdefault(kind, json.dumps(kind)) if isinstance(kind, str) else json.dumps(kind)
                key, at = (json.dumps(path), name), (file, split, place, nth)
                if key not in first or at < first[key]:
                    first[key] = at
    rows = [(*key, *at) for key, at in first.items()]
    if rows:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", "type", "file", "split", "place", "nth"])


def key_paths(records: DataFrame) -> list[tuple[list[str], object]]:
    """The key paths of ``records(file, split, place, text)`` in order of appearance, each with the type that fits all its
    values. Runs one job; the driver gets a row for each path and type. ValueError if a record is not a JSON object.

    A key that holds objects in some records and other values in others is one text column.
    """
    found = records.select("file", "split", "place", "text").mapInArrow(_seen, _SEEN)
    at = F.min(F.struct("file", "split", "place", "nth")).alias("at")
    rows = found.groupBy("path", "type").agg(at).collect()
    types: dict[tuple, object] = {}
    for r in sorted(rows, key=lambda r: tuple(r["at"])):
        path, kind = tuple(json.loads(r["path"])), json.loads(r["type"])
        if not kind:
            raise ValueError("not every record is a JSON object")
        types[path] = merged(types.get(path, "null"), kind)
    nested = {path[:n] for path in types for n in range(1, len(path))}
    mixed = {path for path in nested if types.get(path, "null") != "null"}
    kept: dict[tuple, object] = {}
    for path, kind in types.items():
        outer = next((path[:n] for n in range(1, len(path) + 1) if path[:n] in mixed), None)
        if outer is not None:
            kept[outer] = "string"
        elif path not in nested:
            kept[path] = kind
    return [(list(path), kind) for path, kind in kept.items()]


def _spark_type(kind) -> T.DataType:
    if isinstance(kind, str):
        return _SPARK[kind]
    if kind[0] == "array":
        return T.ArrayType(_spark_type(kind[1]))
    return T.StructType([T.StructField(k, _spark_type(t)) for k, t in kind[1]])


def _schema(paths: list[tuple[list[str], object]]) -> T.StructType:
    tree: dict = {}
    for path, kind in paths:
        level = tree
        for key in path[:-1]:
            level = level.setdefault(key, {})
        level[path[-1]] = _spark_type(kind)

    def built(level: dict) -> T.StructType:
        return T.StructType([T.StructField(k, built(v) if isinstance(v, dict) else v) for k, v in level.items()])

    return built(tree)


def table(records: DataFrame) -> DataFrame:
    """Flat columns in order of appearance, and ``FILE_ORDER``, from ``records(file, split, place, text)``. Runs one job."""
    paths = key_paths(records)
    if not paths:
        raise ValueError("no columns to parse")
    parsed = records.select(F.from_json("text", _schema(paths)).alias("r"), F.struct("file", "split", "place").alias("o")).select("r.*", "o")
    flat, found = _leaves(parsed, 1)
    order = [found.index(path) for path, _ in paths]
    names = unique_names([normal_name(".".join(path)) for path, _ in paths])
    return flat.select(*[f"c{i}" for i in order], f"c{len(found)}").toDF(*names, FILE_ORDER)
