"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector passes it if their dot product exceeds a bound. Directions are a random product
code: the vector is turned by a random rotation and split in halves, and every pair of one code word for each half is
a direction. The sorted scores of the halves list all directions that a vector exceeds, without
looking at the others. Vectors of one label that share a filter meet, and their cosine is checked in double
precision; a pair counts in the first filter that it shares. Equal vectors are one class before the filters. A
filter that very many vectors pass is cut into blocks that meet two by two. Tasks give counts and spanning links
only, never all pairs.

The number of code words grows with the square root of the number of vectors; the bound follows from how many
filters a vector should pass. A vector that exceeds fewer takes its best ones.

After a random rotation, whether a pair shares a filter depends on its cosine alone. How often a pair right at the
least cosine shares none is measured on random pairs for the actual numbers of words and dimensions; so many
independent codes are used that all of them miss a pair with a chance under MISS. Vectors of fewer than four
dimensions, and any under so low a cosine that MOST_CODES codes are too few, all share one filter: they meet in blocks.

Defined results: null vectors, zero vectors, vectors with null or non-finite components and vectors without a label
link with nothing; vectors of different lengths do not link; repeated rows are copies; rows that share an id are
one node of the components; a null id has a null component and is kept; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.llm.components import components
from rowquarry.session import materialise

PASSED = 24  # filters of a code that a vector of random direction exceeds
AT_LEAST = 24
MISS = 1e-6  # chance that a pair at the least cosine shares no filter
TRIALS = 16_384  # random pairs that a code's own rate is measured on
MOST_CODES = 32
BLOCK = 512
SHARD_ROWS = 8192


@lru_cache(maxsize=8)
def code_words(dims: int, words: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, first code, second code) of the product code; a pair of words has unit length."""
    rng = np.random.default_rng([seed, dims, words])
    half = dims // 2
    codes = []
    for size in (half, dims - half):
        code = rng.normal(size=(words, size))
        codes.append(code / np.maximum(np.linalg.norm(code, axis=1, keepdims=True), 1e-12) / math.sqrt(2))
    return np.linalg.qr(rng.normal(size=(dims, dims)))[0], *codes


@lru_cache(maxsize=64)
def bound(dims: int, words: int, passed: int = PASSED) -> float:
    """Dot product that a random unit vector exceeds with ``passed`` of all directions, on average."""
    x = np.linspace(-1, 1, 400_001)[1:-1]
    density = np.power(1 - x * x, (dims - 3) / 2)
    above = np.cumsum(density[::-1])[::-1] / density.sum()
    return float(x[np.searchsorted(-above, -min(1.0, passed / words**2))])


def _exceeded_of(vectors: np.ndarray, words: int, code: int) -> list[np.ndarray]:
    """Numbers of all directions of one code that each unit vector exceeds; its best ones if they are few."""
    dims = vectors.shape[1]
    turn, one, two = code_words(dims, words, 3 + code)
    turned = vectors @ turn
    half, least = dims // 2, bound(dims, words)
    a, b = turned[:, :half] @ one.T, turned[:, half:] @ two.T
    out = []
    for x, y in zip(a, b):
        by = np.argsort(-y)
        falling = -y[by]
        rows = np.flatnonzero(x >= least + falling[0])
        count = np.searchsorted(falling, x[rows] - least, "right")
        if count.sum() >= AT_LEAST:
            found = np.repeat(rows, count) * words + by[np.concatenate([np.arange(c) for c in count])]
        else:
            top_x, top_y = np.argsort(-x)[:AT_LEAST], by[:AT_LEAST]
            best = np.argsort(-(x[top_x][:, None] + y[top_y][None, :]), axis=None)[:AT_LEAST]
            found = top_x[best // len(top_y)] * words + top_y[best % len(top_y)]
        out.append(found)
    return out


def exceeded(vectors: np.ndarray, words: int, codes: int) -> list[np.ndarray]:
    """Sorted numbers of the directions of all codes that each unit vector passes; one and the same for no codes."""
    if not codes:
        return [np.zeros(1, np.int64)] * len(vectors)
    by_code = [_exceeded_of(vectors, words, code) for code in range(codes)]
    return [np.sort(np.concatenate([found + code * words**2 for code, found in enumerate(of)])) for of in zip(*by_code)]


def pairs_at(cosine: float, pairs: int, dims: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors at a cosine."""
    x = unit(rng.normal(size=(pairs, dims)))
    y = rng.normal(size=(pairs, dims))
    y = unit(y - (y * x).sum(1, keepdims=True) * x)
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * y


def missed(x: np.ndarray, y: np.ndarray, words: int, codes: int) -> int:
    """Number of pairs that share no filter."""
    return sum(not np.isin(a, b).any() for a, b in zip(exceeded(x, words, codes), exceeded(y, words, codes)))


@lru_cache(maxsize=256)
def codes_for(dims: int, words: int, least: float) -> int:
    """Independent codes that together miss a pair at cosine ``least`` with a chance under MISS, by the rate of one code
    with three standard deviations and seven misses on top of those counted; 0 if one filter has to do for all."""
    if dims < 4 or least <= 0:
        return 0
    rng, lost = np.random.default_rng([7, dims, words]), 0
    for _ in range(0, TRIALS, 512):
        lost += missed(*pairs_at(min(1.0, least), 512, dims, rng), words, 1)
    rate = (lost + 3 * math.sqrt(lost) + 7) / TRIALS
    codes = math.ceil(math.log(MISS) / math.log(rate)) if rate < 1 else MOST_CODES + 1
    return codes if codes <= MOST_CODES else 0


def usable(column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Rows with a vector that has a direction, and the vectors in double precision."""
    rows, vectors = [], []
    for k in np.flatnonzero(~pc.is_null(column).to_numpy(zero_copy_only=False)):
        values = column[int(k)].values
        if len(values) and not values.null_count:
            v = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            if np.isfinite(v).all() and v.any():
                rows.append(int(k))
                vectors.append(v)
    return rows, vectors


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _keyed(rows: DataFrame) -> DataFrame:
    """(id, label, vec, ck) with a key of the label and the vector's values; null where nothing can link."""
    schema = T.StructType([rows.schema["id"]]).add("label", "string").add("vec", "binary").add("ck", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec: list[bytes | None] = [None] * batch.num_rows
            ck: list[bytes | None] = [None] * batch.num_rows
            labels = batch.column(1).to_pylist()
            for k, v in zip(*usable(batch.column(2))):
                if labels[k] is not None:
                    vec[k] = v.tobytes()
                    ck[k] = hashlib.blake2b(vec[k] + labels[k].encode(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vec, pa.binary()), pa.array(ck, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def _filtered(classes: DataFrame, words: int, codes: dict[int, int]) -> DataFrame:
    """One row per class and filter: (bucket, filter, ck, copies, vec, the class's filters of smaller number)."""
    schema = T.StructType().add("label", "string").add("dims", "long").add("filter", "long").add("ck", "binary")
    schema = schema.add(classes.schema["id"]).add("copies", "long").add("vec", "binary").add("filters", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 512):
                batch = whole.slice(low, 512)
                raw = batch.column(4).to_pylist()
                dims = np.array([len(v) // 8 for v in raw])
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    lists = exceeded(unit(np.frombuffer(b"".join(raw[k] for k in at), np.float64).reshape(len(at), d)), words, codes[int(d)])
                    row = np.repeat(at, [len(x) for x in lists])
                    part = batch.take(pa.array(row))
                    packed = [x.astype(np.int32).tobytes() for x in lists]
                    again = pa.array([p[: 4 * k] for p, x in zip(packed, lists) for k in range(len(x))], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(np.full(len(row), d, np.int64)), pa.array(np.concatenate(lists).astype(np.int64)), *part.columns[1:], again], schema.names
                    )

    return classes.select("label", "ck", "id", "copies", "vec").mapInArrow(run, schema)


def _bucket_links(vectors: np.ndarray, lists: list[np.ndarray], number: int, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(pairs to count here, all links) among vectors that share a filter; two sides meet only each other."""
    links = vectors @ vectors.T >= least
    np.fill_diagonal(links, False)
    if side[0] != side[-1]:
        links &= side[:, None] != side[None, :]
    here = links
    if links.any():
        earlier = [x[x < number] for x in lists]
        flat = np.concatenate(earlier)
        if len(flat):
            known, index = np.unique(flat, return_inverse=True)
            member = np.zeros((len(lists), len(known)), np.float32)
            member[np.repeat(np.arange(len(lists)), [len(x) for x in earlier]), index] = 1
            here = links & (member @ member.T == 0)
    return here, links


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Links that hang every vector of a component on its first."""
    fresh, out = links.any(1), []
    while fresh.any():
        root = int(np.argmax(fresh))
        front = np.array([root])
        fresh[root] = False
        while len(front):
            front = np.flatnonzero(links[front].any(0) & fresh)
            fresh[front] = False
            out += [(root, int(k)) for k in front]
    return out


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, block: int = BLOCK) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``rows``. Runs its jobs; what it keeps between them is in
    the shared folder."""
    named = rows.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"))
    keyed = materialise(_keyed(named), "caps-rows")
    classes = keyed.filter("ck is not null").groupBy("ck").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec")
    )
    classes = materialise(classes, "caps-classes")
    words = 1 << max(6, min(12, math.ceil(math.log2(2 * math.sqrt(max(1, classes.count()))))))
    dims = [r[0] // 8 for r in classes.select(F.octet_length("vec")).distinct().collect()]  # the few lengths of vectors
    passed = materialise(_filtered(classes, words, {d: codes_for(d, words, least) for d in dims}).withColumn("bucket", F.xxhash64("label", "dims", "filter")), "caps-filters")
    size = passed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    size = materialise(size.select("bucket", "n", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "caps-sizes")
    total = size.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD_ROWS))
    met = passed.join(size, "bucket")
    mine = F.pmod(F.xxhash64("ck"), F.col("blocks")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shard = F.when(F.col("blocks") > 1, F.col("bucket")).otherwise(F.pmod(F.col("bucket"), F.lit(shards)))
    met = met.select(
        shard.alias("shard"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine",
        "bucket", "dims", "label", "filter", "ck", "id", "copies", "vec", "filters",
    )
    kind = keyed.schema["id"].dataType
    schema = T.StructType().add("ck", "binary").add("n", "long").add(T.StructField("a", kind)).add(T.StructField("b", kind))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bucket", "label", "dims", "filter", "mine"]).reset_index(drop=True)
        step = (frame[["bucket", "label", "dims", "filter"]] != frame[["bucket", "label", "dims", "filter"]].shift()).any(axis=1)
        cuts = np.append(np.flatnonzero(step.to_numpy()), len(frame))
        raw, packed = frame["vec"].to_list(), frame["filters"].to_list()
        ids, copies, number, side = frame["id"].to_list(), frame["copies"].to_numpy(), frame["filter"].to_numpy(), frame["mine"].to_numpy()
        ck, out = frame["ck"].to_list(), []
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            vectors = unit(np.frombuffer(b"".join(raw[a:b]), np.float64).reshape(b - a, -1))
            if b - a == 2 and vectors[0] @ vectors[1] < least:
                continue
            lists = [np.frombuffer(p, np.int32) for p in packed[a:b]]
            here, links = _bucket_links(vectors, lists, number[a], side[a:b], least)
            if links.any():
                counted = here @ copies[a:b]
                out += [(ck[a + k], int(counted[k]), None, None) for k in np.flatnonzero(counted)]
                out += [(None, None, ids[a + x], ids[a + y]) for x, y in _forest(links)]
        made = pd.DataFrame(out, columns=schema.names).astype(object)
        return made.where(made.notna(), None)

    found = materialise(met.groupBy("shard", "i", "j").applyInPandas(run, schema), "caps-found")
    counts = found.filter("ck is not null").groupBy("ck").agg(F.sum("n").alias("linked"))
    links = found.filter("ck is null and a is not null and b is not null").select("a", "b")
    rows_of = keyed.filter("ck is not null and id is not null").select("ck", "id")
    shared = rows_of.groupBy("id").agg(F.count("*").alias("m")).filter("m > 1").select("id")
    own = rows_of.join(shared, "id").join(classes.select("ck", F.col("id").alias("head")), "ck").filter("id <> head")
    known = components(links.union(own.select(F.col("id").alias("a"), F.col("head").alias("b"))))
    placed = keyed.select("id", "ck").join(classes.select("ck", "copies", F.col("id").alias("head")), "ck", "left").join(counts, "ck", "left")
    placed = placed.withColumn("head", F.coalesce("head", "id")).join(known, F.col("head") == F.col("node"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "head"))
    return placed.select(
        F.col("id").alias(key),
        (F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
