"""Near-duplicate documents: MinHash signatures, banding, verification on full shingle sets, components.

Texts with equal shingle sets are one class with its smallest id. Class signatures hold many universal hash minima,
cut into bands; classes that share a band's values meet in a bucket. First every class of a bucket is checked
against the bucket's first class, which merges groups of copies without forming their pairs. Then, only where a
bucket still holds several components, classes of different components are compared in blocks: by signature, and
the likely pairs fully. A check compares the full shingle sets of the whole texts. The number of bands
follows from the similarity: a linked pair shares no bucket with a chance of one in a million at the threshold.

Defined results: texts without words and null texts have no shingle and are linked with nothing; rows that share an
id are one document; a row with a null id has a null component and is kept; repeated rows are one class; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.llm import texts
from rowquarry.llm.components import components
from rowquarry.session import fits_broadcast, materialise

ROWS = 5  # minima in a band
MISS = 1e-6
BLOCK = 256  # classes of a bucket that one task compares with as many others


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def likely(percent: int, minima: int) -> int:
    """Equal minima of two signatures that a linked pair falls short of with a chance under one in ten million."""
    s = percent / 100
    return int(minima * (s - 5.5 * math.sqrt(s * (1 - s) / minima)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text, A-Z lowered."""
    data = texts.LOWER[data]
    starts, ends = texts.words(data, offsets)
    of = texts.owner(offsets, starts)
    word = texts.range_hash(texts.prefix_hash(data), starts, ends)
    shingle, first = texts.in_sequence(word, of, n)
    cut = np.searchsorted(of[first], np.arange(len(offsets)))
    bound = np.searchsorted(of, np.arange(len(offsets)))
    sets = []
    for i in range(len(offsets) - 1):
        if cut[i + 1] > cut[i]:
            sets.append(np.unique(shingle[cut[i] : cut[i + 1]]))
        elif bound[i + 1] > bound[i]:
            few = word[bound[i] : bound[i + 1]]
            sets.append(texts.in_sequence(few + np.uint64(len(few)), np.zeros(len(few), np.int64), len(few))[0])
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_key(shingles: np.ndarray) -> bytes:
    """Digest that names a set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _family(minima: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(31)
    return rng.integers(0, 1 << 31, minima, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, minima, dtype=np.uint32)


def signatures(sets: list[np.ndarray], minima: int) -> np.ndarray:
    """Minimum of each universal hash function over each set; sets must not be empty."""
    a, b = _family(minima)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), minima), np.uint32)
    scratch = np.empty_like(flat)
    for k in range(minima):
        np.multiply(flat, a[k], out=scratch)
        np.add(scratch, b[k], out=scratch)
        out[:, k] = np.minimum.reduceat(scratch, starts)
    return out


def _sketches(docs: DataFrame, key: str, text: str, n: int, minima: int) -> DataFrame:
    schema = T.StructType([T.StructField("id", docs.schema[key].dataType)]).add("n_shingles", "long").add("set_key", "binary").add("sig", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in texts.blocks(batches, "__text"):
            sets = shingle_sets(data, at, n)
            some = [k for k, s in enumerate(sets) if len(s)]
            keys: list[bytes | None] = [None] * len(sets)
            sigs: list[bytes | None] = [None] * len(sets)
            if some:
                for k, sig in zip(some, signatures([sets[k] for k in some], minima)):
                    keys[k], sigs[k] = set_key(sets[k]), sig.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                schema.names,
            )

    return docs.select(F.col(key).alias("id"), F.col(text).alias("__text")).mapInArrow(run, schema)


def _verified(pairs: DataFrame, involved: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) of ids among pairs (x, y) of classes whose full shingle sets are similar enough."""
    left = involved.select(F.col("set_key").alias("x"), F.col("id").alias("a"), F.col("text").alias("text_x"))
    right = involved.select(F.col("set_key").alias("y"), F.col("id").alias("b"), F.col("text").alias("text_y"))
    both = pairs.join(right, "y").join(left, "x").select("x", "a", "b", "text_x", "text_y")
    kind = involved.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for part, data, at in texts.blocks(batches, "text_y"):
            keep = []
            xs, firsts = part.column(0).to_pylist(), part.column(3)
            for k, mine in enumerate(shingle_sets(data, at, n)):
                if xs[k] not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[xs[k]] = shingle_sets(*texts.text_bytes(firsts.slice(k, 1)), n)[0]
                other = known[xs[k]]
                place = np.minimum(np.searchsorted(other, mine), len(other) - 1)
                shared = int((other[place] == mine).sum())
                keep.append(100 * shared >= percent * (len(mine) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (part.column(1), part.column(2))], ["a", "b"])

    return both.mapInArrow(run, schema)


def _involved(docs: DataFrame, classes: DataFrame, keys: DataFrame, key: str, text: str, sketched: DataFrame, words: int) -> DataFrame:
    """(set_key, id, text) of the classes with these keys; one text of each class."""
    need = materialise(keys.distinct().join(classes.select("set_key", "id"), "set_key"), "near-need")
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    found = rows.join(F.broadcast(need) if fits_broadcast(need) else need, "id")
    repeated = sketched.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    if repeated.isEmpty():
        return materialise(found.select("set_key", "id", "text"), "near-texts")

    def own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in texts.blocks(batches, "text"):
            keys = part.column(0).to_pylist()
            yield part.filter(pa.array([set_key(s) == k for s, k in zip(shingle_sets(data, at, words), keys)], pa.bool_()))

    found = found.select("set_key", "id", "text")
    return materialise(found.mapInArrow(own_text, found.schema).dropDuplicates(["set_key"]), "near-texts")


def _open_buckets(crowded: DataFrame, known: DataFrame) -> DataFrame:
    """The classes of buckets that still hold several components: their component and the bucket's number of blocks."""
    labelled = crowded.join(known.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    several = several.filter("low <> high").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    return materialise(labelled.join(several, "bucket").select("bucket", "band", "blocks", "set_key", "id", "component", "n_shingles"), "near-open")


def _links_in_blocks(open_: DataFrame, involved: DataFrame, n: int, percent: int, bands: int) -> DataFrame:
    """Links (a, b) between different components of a bucket. Blocks of its classes meet two by two; a task compares
    signatures, checks the full sets of likely pairs, each pair in the first band it shares, and gives only links that
    join what it had not joined yet."""
    block = F.pmod(F.xxhash64("set_key", F.lit(1)), F.col("blocks")).cast("int")
    dealt = open_.withColumn("mine", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "band", "set_key", "id", "component", "n_shingles"
    ).join(involved.select("set_key", "text"), "set_key")
    minima = bands * ROWS
    least = likely(percent, minima)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        data, at = texts.text_bytes(pa.array(frame["text"], pa.large_string()))
        sets = shingle_sets(data, at, n)
        sig = signatures(sets, minima)
        band = int(frame["band"].iloc[0])
        by_band = sig.reshape(len(sets), bands, ROWS)
        where, size = frame["mine"].to_numpy(), frame["n_shingles"].to_numpy()
        same_block = frame["i"].iloc[0] == frame["j"].iloc[0]
        group = pd.factorize(frame["component"])[0]
        ids, links = frame["id"].to_list(), []
        for k in range(len(sets)):
            ahead = np.arange(len(sets)) > k if same_block else (where != where[k]) & (where[k] == frame["i"].iloc[0])
            ahead &= (group != group[k]) & (100 * np.minimum(size, size[k]) >= percent * np.maximum(size, size[k]))
            near = np.flatnonzero(ahead)
            near = near[(sig[near] == sig[k]).sum(1) >= least]
            near = near[(by_band[near] == by_band[k]).all(2).argmax(1) == band]
            for m in near:
                if group[m] != group[k]:
                    place = np.minimum(np.searchsorted(sets[k], sets[m]), len(sets[k]) - 1)
                    shared = int((sets[k][place] == sets[m]).sum())
                    if 100 * shared >= percent * (len(sets[k]) + len(sets[m]) - shared):
                        links.append((ids[k], ids[m]))
                        group[group == group[m]] = group[k]
        return pd.DataFrame(links, columns=["a", "b"])

    kind = involved.schema["id"].dataType
    return dealt.groupBy("bucket", "i", "j").applyInPandas(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``; ``percent`` of similarity links. Runs its
    jobs; what it keeps between them is in the shared folder."""
    bands = bands_for(percent)
    minima = bands * ROWS
    sketched = materialise(_sketches(docs, key, text, words, minima), "near-sketches")
    named = sketched.filter("set_key is not null and id is not null")
    classes = materialise(
        named.groupBy("set_key").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "near-classes"
    )
    width = 4 * ROWS
    bucket = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 1 + k * width, width)) for k in range(bands)])
    banded = classes.select("set_key", "id", "n_shingles", F.posexplode(bucket).alias("band", "bucket"))
    heads = banded.groupBy("bucket").agg(F.min("set_key").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n")
    crowded = materialise(banded.join(heads, "bucket"), "near-buckets")

    first = crowded.filter("head <> set_key").select(F.col("head").alias("x"), F.col("set_key").alias("y")).distinct()
    sides = first.join(classes.select(F.col("set_key").alias("y"), F.col("sig").alias("sig_y"), F.col("n_shingles").alias("n_y")), "y").join(
        classes.select(F.col("set_key").alias("x"), F.col("sig").alias("sig_x"), F.col("n_shingles").alias("n_x")), "x"
    )
    first = materialise(_alike(sides.filter(100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")), likely(percent, minima)), "near-pairs")
    both = first.select(F.col("x").alias("set_key")).union(first.select(F.col("y").alias("set_key")))
    found = _verified(first, _involved(docs, classes, both, key, text, named, words), words, percent)

    rows = named.join(classes.select("set_key", F.col("id").alias("head")), "set_key")
    own = rows.join(named.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "id").filter("id <> head")
    links = materialise(found.union(own.select(F.col("id").alias("a"), F.col("head").alias("b"))), "near-links")
    known = components(links)
    open_ = _open_buckets(crowded, known)
    if not open_.isEmpty():
        more = _links_in_blocks(open_, _involved(docs, classes, open_.select("set_key"), key, text, named, words), words, percent, bands)
        known = components(links.union(more))
    placed = sketched.join(classes.select("set_key", F.col("id").alias("head")), "set_key", "left").withColumn("head", F.coalesce("head", "id"))
    placed = placed.join(known, placed["head"] == known["node"], "left").withColumn("component_id", F.coalesce("component", "head"))
    placed = placed.withColumn("component_id", F.when(F.col("id").isNotNull(), F.col("component_id")))
    return placed.select(
        F.col("id").alias(key), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _alike(sides: DataFrame, least: int) -> DataFrame:
    """Pairs whose signatures agree in ``least`` minima at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                a = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(part.num_rows, -1)
                b = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint32).reshape(part.num_rows, -1)
                part = part.filter(pa.array((a == b).sum(1) >= least))
            yield part.select([0, 1])

    return sides.select("x", "y", "sig_x", "sig_y").mapInArrow(run, "x binary, y binary")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, with all their columns, of the first document of each component. Rows that share an id and
    a text leave one row, and unlike texts of one id stay; rows without an id stay. Columns may have any names."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    own = f"c{names.index(key)}"
    found = materialise(near_duplicates(docs, key, text, **how), "near-found")
    gone = found.filter(~F.col("kept")).select(F.col(key).alias(own)).distinct()
    left = plain.join(F.broadcast(gone) if fits_broadcast(gone) else gone, own, "left_anti")
    if not found.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        again = [own, f"c{names.index(text)}"]
        left = left.filter(F.col(own).isNotNull()).dropDuplicates(again).unionByName(left.filter(F.col(own).isNull()))
    return left.select(*plain.columns).toDF(*names)
