"""Removal of repeated passages: every byte covered by a long string that also starts earlier.

Each string of LENGTH bytes is owned by one anchor, the GRAM bytes of it with the smallest hash; equal strings have
equal anchors at the same place. So the strings of a document fall into stretches with one anchor each, and only
stretches with equal anchors can hold equal strings. Anchors are dealt out and sorted by hash: an anchor that occurs
once is dropped, and of stretches that agree entirely all but the first are marked (those of one document before
they are dealt out). What is left, stretches with the
same anchor and different surroundings, is fetched as text and dealt over shards of bounded size; each shard's
suffix array (by induced sorting) and permuted common prefixes show the equal strings, of which all but the first
are marked. An anchor with very many different surroundings is salted over several shards, and the first strings of
each of them are compared once more by their digests.

Defined results: null and empty texts have no bytes; documents are in order of their id, null ids last; rows that
share id and text are one document, and rows that share the id alone are in the order of a digest of their texts; an
empty table gives no rows; other columns pass through unseen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.llm import texts
from rowquarry.llm.suffixes import common_prefixes, suffix_array
from rowquarry.session import fits_broadcast, materialise

LENGTH = 100
GRAM = 32
PIECE = 4 << 20  # bytes of one text looked at together; strings that cross a cut belong to the piece they start in
SHARD = 8192  # stretches in a shard, about
_PLACE_BITS = 24


def _stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start, strings, anchor hash, digest) of every stretch of the texts of a block."""
    n = len(data)
    span = length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = texts.prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    gram = texts.range_hash(prefix, at, at + GRAM)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    best = (gram & ~low) | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        rest = span - width
        best = np.minimum(best[:-rest], best[rest:])
    starts = np.arange(len(best))
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = of[: len(best)] == of[length - 1 :]
    starts, anchor, of = starts[whole], (best[whole] & low).astype(np.int64), of[: len(best)][whole]
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])]))
    count = np.diff(np.append(new, len(starts)))
    first, anchor, of = starts[new], anchor[new], of[new]
    digest = texts.mixed(texts.range_hash(prefix, first, first + count + length - 1) + (anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return of, first - offsets[of], count, gram[anchor], digest


def _anchors(rows: DataFrame, length: int) -> DataFrame:
    schema = T.StructType().add("h", "long").add("g", "long").add(rows.schema["doc"]).add("tie", "long").add("start", "long").add("n", "long")
    schema = schema.add("own", "boolean")  # whether it equals an earlier stretch of the same document

    def one(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, shift: int = 0) -> pa.RecordBatch:
        of, start, count, h, g = _stretches(data, offsets, length)
        own = np.ones(len(of), bool)
        own[np.unique(texts.mixed(h * np.uint64(3) + g) + of.astype(np.uint64), return_index=True)[1]] = False
        if own.any():  # a run of such stretches becomes one, dealt by a number of its own
            follows = np.zeros(len(of), bool)
            follows[1:] = own[1:] & own[:-1] & (of[1:] == of[:-1])
            lead = np.flatnonzero(~follows)
            count = np.add.reduceat(count, lead)
            of, start, h, g, own = of[lead], start[lead], h[lead], g[lead], own[lead]
            h = np.where(own, texts.mixed(h + start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h)
        take = pa.array(of)
        return pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take),
             pa.array(start + shift), pa.array(count), pa.array(own)],
            schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in texts.blocks(batches, "__text", max_rows=10_000):
            if len(data) <= PIECE:
                yield one(part, data, at)
                continue
            for low in range(0, len(data), PIECE):  # a block of more bytes is one text
                piece = data[low : low + PIECE + length - 1]
                yield one(part, piece, np.array([0, len(piece)]), low)

    return rows.mapInArrow(run, schema)


def _shared(anchors: DataFrame) -> DataFrame:
    """Stretches whose anchor occurs again: ``open`` ones must be compared as text, the others equal an earlier one.

    A task reads its anchors in order of hash and keeps one row between batches, however often an anchor occurs."""
    order = ["h", "g", F.col("doc").isNull(), "doc", "tie", "start"]
    sorted_ = anchors.repartition("h").sortWithinPartitions(*order)
    schema = T.StructType([*anchors.schema.fields]).add("open", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_h = last_g = head = None  # head: first row of the anchor at hand, until it is given out
        for batch in batches:
            repeats = batch.filter(batch.column(6))
            yield pa.RecordBatch.from_arrays([*repeats.columns, pa.array(np.zeros(repeats.num_rows, bool))], schema.names)
            batch = batch.filter(pc.invert(batch.column(6)))
            if not batch.num_rows:
                continue
            h, g = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same_h = np.concatenate([[last_h is not None and h[0] == last_h], h[1:] == h[:-1]])
            same_c = same_h & np.concatenate([[last_g is not None and g[0] == last_g], g[1:] == g[:-1]])
            group = np.cumsum(~same_h)
            begin = np.flatnonzero(~same_h)
            second = same_h & ~same_c
            open_ = second.copy()
            groups = np.unique(group[second])
            heads = groups[groups > 0]
            open_[begin[heads - 1]] = True
            if len(groups) and groups[0] == 0 and head is not None:
                yield pa.RecordBatch.from_arrays([*head.columns, pa.array([True])], schema.names)
                head = None
            give = open_ | same_c
            yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(give)).columns, pa.array(open_[give])], schema.names)
            if len(begin):
                head = None if len(heads) and heads[-1] == group[-1] else batch.slice(int(begin[-1]), 1)
            last_h, last_g = h[-1], g[-1]

    return sorted_.mapInArrow(run, schema)


def _by_document(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Join what was found in each document to its rows: sent to all tasks if measured small, else by shuffle."""
    found = found.withColumnsRenamed({"doc": "__doc", "tie": "__tie"})
    same: Column = rows["doc"].eqNullSafe(found["__doc"]) & (rows["tie"] == found["__tie"])
    return rows.join(F.broadcast(found) if fits_broadcast(found) else found, same, how).drop("__doc", "__tie")


def _texts_of(rows: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """The open stretches with their bytes."""
    wanted = open_.groupBy("doc", "tie").agg(F.collect_list("h").alias("h"), F.collect_list("start").alias("at"), F.collect_list("n").alias("n"))
    wanted = materialise(wanted, "passages-wanted")
    schema = T.StructType([open_.schema["doc"], *[open_.schema[c] for c in ("tie", "h", "start", "n")]]).add("bytes", "binary")
    joined = _by_document(rows, wanted, "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in texts.blocks(iter([batch]), "__text"):
                h, start, n = (part.column(k) for k in (3, 4, 5))
                row = pc.list_parent_indices(h).to_numpy().astype(np.int64)
                begin = start.flatten().to_numpy() + at[row]
                stop = begin + n.flatten().to_numpy() + length - 1
                raw = data.tobytes()
                own = pa.array([raw[a:b] for a, b in zip(begin.tolist(), stop.tolist())], pa.binary())
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), h.flatten(), start.flatten(), n.flatten(), own], schema.names
                )

    return joined.select("doc", "tie", "__text", "h", "at", "n").mapInArrow(run, schema)


def repeats_in(pieces: list[bytes], order: np.ndarray, length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For every piece of text which of its strings equal an earlier one of another piece or of itself, and which
    are the first of several. ``order`` ranks the pieces."""
    size = np.array([len(p) for p in pieces])
    flat = np.full(int(size.sum()) + len(pieces) + 1, 1, np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    flat[-1] = 0
    of = np.repeat(np.arange(len(pieces)), size)
    inner = np.arange(int(size.sum())) + of
    flat[inner] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 2
    sa = suffix_array(flat)
    shared = common_prefixes(flat, sa)
    group = np.cumsum(shared[sa] < length)
    piece = np.full(len(flat), -1)
    piece[inner] = of
    at = piece[sa]
    offset = sa - begin[np.maximum(at, 0)]
    fits = (at >= 0) & (offset + length <= size[np.maximum(at, 0)])
    at, offset, group = at[fits], offset[fits], group[fits]
    again, first = [np.zeros(0, np.int64)] * len(pieces), [np.zeros(0, np.int64)] * len(pieces)
    if not len(at):
        return again, first
    rank = order[at].astype(np.int64) * (1 << 32) + offset
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.repeat(np.minimum.reduceat(rank, cut), np.diff(np.append(cut, len(rank))))
    for wanted, out in ((rank != least, again), (rank == least, first)):
        p, o = at[wanted], offset[wanted]
        by = np.lexsort((o, p))
        p, o = p[by], o[by]
        bounds = np.searchsorted(p, np.arange(len(pieces) + 1))
        for k in range(len(pieces)):
            out[k] = o[bounds[k] : bounds[k + 1]]
    return again, first


def _marks_in_shards(open_: DataFrame, fetched: DataFrame, length: int, shard: int) -> DataFrame:
    """(doc, tie, start, stop, key): bytes to remove, and with a key the first strings of a salted anchor's shard."""
    shards = max(1, -(-open_.count() // shard))
    hot = open_.groupBy("h").agg(F.ceil(F.count("*") / (shard // 4)).cast("int").alias("salts")).filter("salts > 1")
    hot = materialise(hot, "passages-hot")
    dealt = fetched.join(F.broadcast(hot) if fits_broadcast(hot) else hot, "h", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    own = F.pmod(F.xxhash64("doc", "tie", "start"), F.col("salts")).cast("int")
    dealt = dealt.withColumn("salt", F.when(F.col("salts") > 1, own).otherwise(F.lit(-1)))
    dealt = dealt.withColumn("shard", F.when(F.col("salts") > 1, F.col("h")).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards))))
    dealt = dealt.select("doc", "tie", "start", "n", "bytes", "salts", "shard", "salt")
    schema = T.StructType([open_.schema["doc"], open_.schema["tie"]]).add("start", "long").add("stop", "long").add("key", "binary")

    def run(table: pa.Table) -> pa.Table:
        table = table.append_column("none", pc.is_null(table.column("doc")))
        table = table.sort_by([(c, "ascending") for c in ("none", "doc", "tie", "start")]).combine_chunks()
        pieces = table.column("bytes").to_pylist()
        again, first = repeats_in(pieces, np.arange(len(pieces)), length)
        start = table.column("start").to_numpy()
        row, low, high, key = [], [], [], []
        salted = table.column("salts")[0].as_py() > 1
        for k, places in enumerate(again):
            if len(places):
                runs = np.flatnonzero(np.concatenate([[True], np.diff(places) > 1]))
                for a, b in zip(places[runs], places[np.append(runs[1:], len(places)) - 1]):
                    row.append(k)
                    low.append(int(start[k] + a))
                    high.append(int(start[k] + b + length))
                    key.append(None)
            if salted:
                for a in first[k].tolist():
                    row.append(k)
                    low.append(int(start[k] + a))
                    high.append(int(start[k] + a + length))
                    key.append(hashlib.blake2b(pieces[k][a : a + length], digest_size=16).digest())
        take = pa.array(row, pa.int64())
        return pa.table(
            [table.column("doc").take(take), table.column("tie").take(take), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(key, pa.binary())],
            names=schema.names,
        )

    return dealt.groupBy("shard", "salt").applyInArrow(run, schema)


def _merged(marks: DataFrame) -> DataFrame:
    """(doc, tie, spans): each document's maximal removed runs, as pairs of 64-bit integers."""
    listed = marks.groupBy("doc", "tie").agg(F.collect_list("start").alias("low"), F.collect_list("stop").alias("high"))
    schema = T.StructType([marks.schema["doc"], marks.schema["tie"]]).add("spans", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs, spans = batch.column(2), batch.column(3), []
            for k in range(batch.num_rows):
                low, high = lows[k].values.to_numpy(), highs[k].values.to_numpy()
                by = np.argsort(low, kind="stable")
                low, high = low[by], np.maximum.accumulate(high[by])
                new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
                spans.append(np.stack([low[new], high[np.append(new[1:], len(low)) - 1]], 1).astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.binary())], schema.names)

    return listed.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): ``docs`` with the columns doc, tie and __text, and the runs to remove of each (doc, tie)."""
    if length <= GRAM:
        raise ValueError(f"strings must be longer than {GRAM} bytes")
    repeated = not docs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    tie = F.coalesce(F.xxhash64(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))), F.lit(0)) if repeated else F.lit(0).cast("long")
    rows = docs.withColumns({"doc": F.col(key), "tie": tie, "__text": F.col(text)})
    plain = rows.select("doc", "tie", "__text")
    if repeated:
        plain = plain.dropDuplicates(["doc", "tie"])
    shared = materialise(_shared(_anchors(plain, length)), "passages-shared")
    open_ = shared.filter("open").select("doc", "tie", "h", "start", "n")
    sure = shared.filter("not open").select("doc", "tie", "start", (F.col("start") + F.col("n") + F.lit(length - 1)).alias("stop"))
    found = materialise(_marks_in_shards(open_, _texts_of(plain, open_, length), length, shard), "passages-marks")
    firsts = found.filter("key is not null")
    rank = F.struct(F.col("doc").isNull().alias("none"), "doc", "tie", "start")
    least = firsts.groupBy("key").agg(F.min(rank).alias("least"), F.count("*").alias("m")).filter("m > 1").select("key", "least")
    late = firsts.join(least, "key").filter(rank != F.col("least")).select("doc", "tie", "start", "stop")
    marks = sure.unionByName(found.filter("key is null").select("doc", "tie", "start", "stop")).unionByName(late)
    return rows, materialise(_merged(marks), "passages-spans")


def _cut(data: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, runs removed)."""
    if not spans:
        return data, 0, 0
    pairs = np.frombuffer(spans, np.int64).reshape(-1, 2)
    kept, at = [], 0
    for a, b in pairs.tolist():
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``."""
    rows, spans = repeated_spans(docs, key, text, length)
    joined = _by_document(rows.select("doc", "tie", "__text"), spans, "left").select("doc", "__text", "spans")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)]).add("n_bytes", "long").add("n_removed", "long")
    schema = schema.add("n_spans", "long").add("kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in texts.blocks(batches, "__text", max_rows=4096):
            raw, made = data.tobytes(), []
            for k, span in enumerate(part.column(2).to_pylist()):
                left, removed, runs = _cut(raw[at[k] : at[k + 1]], span)
                made.append((int(at[k + 1] - at[k]), removed, runs, hashlib.sha256(left).hexdigest()))
            columns = [pa.array([m[c] for m in made], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema.names)

    return joined.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut out of the text. Where a cut splits a character, what is left of it goes
    too; a null text stays null."""
    names = docs.columns
    place = names.index(text)
    numbered = [f"c{k}" for k in range(len(names))]
    plain = docs.toDF(*numbered)
    rows, spans = repeated_spans(plain, f"c{names.index(key)}", f"c{place}", length)
    joined = _by_document(rows, spans, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names))
            column = batch.column(place)
            if spans.null_count < batch.num_rows:
                column = pa.array(
                    [t if s is None else _cut(t.encode(), s)[0].decode("utf-8", "ignore") for t, s in zip(column.to_pylist(), spans.to_pylist())], pa.string()
                )
            yield pa.RecordBatch.from_arrays([column if k == place else batch.column(k) for k in range(len(names))], numbered)

    return joined.select(*numbered, "spans").mapInArrow(run, plain.schema).toDF(*names)
