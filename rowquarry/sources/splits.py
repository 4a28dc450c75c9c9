"""Text files read split by split, where a record may begin in one split and end in another.

Whether a place in a file lies inside a quoted field, or how deep in a JSON document, depends on all bytes before it. It is
found in two steps: every split says what it does to any state it may be entered in, one small row each; the driver composes
these in file order; then every split is read again, knowing its state. What a split holds of a record that began earlier
is a fragment; only fragments, two a split at most, are shuffled to be joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowquarry.functions import fixed

CHARSETS = {"utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}


def decoded(value: Column, encoding: str) -> Column:
    """Raw bytes of the text source as text."""
    if encoding == "utf-8":
        return value
    if encoding in CHARSETS:
        return F.decode(value.cast("binary"), CHARSETS[encoding])
    text = F.decode(value.cast("binary"), "ISO-8859-1")
    return F.translate(text, fixed.CP1252_CODES, fixed.CP1252_LETTERS) if encoding == "cp1252" else text


def chunks(spark: SparkSession, files: dict[str, list[str]], ends_with: str) -> DataFrame:
    """(file, split, size, n_bytes, text) of ``files`` by encoding: the decoded text before each ``ends_with``. A split's
    rows come in their order."""
    return reduce(DataFrame.union, [_chunks(spark, paths, encoding, ends_with) for encoding, paths in files.items()])


def _chunks(spark: SparkSession, paths: list[str], encoding: str, ends_with: str) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", ends_with)
    if encoding in CHARSETS:
        reader = reader.option("encoding", CHARSETS[encoding])
    width = len(ends_with.encode(CHARSETS.get(encoding, "utf-8")))
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("size"),
        (F.octet_length("value") + width).cast("long").alias("n_bytes"),
        decoded(F.col("value"), encoding).alias("text"),
    )


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, pa.RecordBatch]]:
    """((file, split), whether it is new, some of its rows in order). The first two columns are file and split."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
        code = files.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            own = (files.dictionary[int(code[a])].as_py(), int(starts[a]))
            yield own, own != last, batch.slice(a, b - a)
            last = own


def joined_fragments(fragments: DataFrame, glue: str) -> DataFrame:
    """Whole records from ``fragments(file, split, place, opens, text, …)``: one that opens and all up to the next that does.
    A record has the other columns of its opening fragment. A window reads a few rows a split."""
    order = Window.partitionBy("file").orderBy("split", "opens", "place").rowsBetween(Window.unboundedPreceding, 0)
    owned = fragments.withColumn("__owner", F.sum(F.col("opens").cast("long")).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("split", "text")))
    kept = [c for c in fragments.columns if c not in ("file", "opens", "text")]
    first = [F.max(F.when(F.col("opens"), F.col(c))).alias(c) for c in kept]
    grouped = owned.filter("__owner > 0").groupBy("file", "__owner").agg(*first, F.array_join(F.transform(pieces, lambda p: p["text"]), glue).alias("text"))
    return grouped.select("file", *kept, "text")


def buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    ).cast(pa.string())
