"""Vectors for text, and exact nearest-vector search over a batch of questions.

Vector tables are ``(doc_id, vec array<float>)``; questions are ``(query_id, vec)``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.functions import fixed
from rowquarry.functions.kernels import BestK
from rowquarry.operators.bm25 import postings, tokenised
from rowquarry.operators.ranking import RANKED, by_question_blocks, top_k
from rowquarry.session import BROADCAST_MAX_BYTES

HASH_DIMENSIONS = 64
VECTOR_ROWS = 4096  # that a task sends at once


def hash_embed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """Signed feature hashing of the tokens, L2-normalised: ``(doc_id, vec)``.

    The default encoder, needing no model. A text without tokens gets the zero vector.
    Everything after the placing shuffle groups on ``doc_id`` and stays in its partition. Runs one job that measures the text.
    """
    tokens = tokenised(docs, id_col, text_col)
    return embed_postings(tokens, postings(tokens), dimensions)


def embed_postings(docs: DataFrame, post: DataFrame, dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """The same vectors from an existing postings table; ``docs`` gives the full list of ids."""
    digest = F.md5(F.col("term").cast("binary"))
    bucket = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dimensions)).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") < 8, 1).otherwise(-1)
    sums = (
        post.select("doc_id", bucket.alias("bucket"), (sign * F.col("tf")).alias("signed"))
        .groupBy("doc_id", "bucket")
        .agg(F.sum("signed").cast("double").alias("value"))
    )
    filled = sums.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("parts"),  # at most `dimensions` entries
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"),
    )
    buckets = F.sequence(F.lit(0), F.lit(dimensions - 1))
    vec = F.transform(
        buckets,
        lambda i: F.when(
            F.col("norm") > 0, F.coalesce(F.element_at(F.col("parts"), i), F.lit(0.0)) / F.col("norm")
        ).otherwise(F.lit(0.0)).cast("float"),
    )
    return docs.select("doc_id").join(filled, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("norm").isNotNull(), vec)
        .otherwise(F.array_repeat(F.lit(0.0).cast("float"), dimensions))
        .alias("vec"),
    )


def embed_files(docs: DataFrame, post: DataFrame, dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """The same vectors from written postings that name their ``file``, which holds all of a document's and is read by one
    task. A task hashes a word once where the file's postings are sorted by term, and only its vectors are shuffled, to
    meet the documents without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            files, terms = batch.column(0).to_numpy(), batch.column(2).dictionary_encode()
            bucket, sign = _hashed(terms.dictionary.to_pylist(), dimensions)
            term = terms.indices.to_numpy()
            rows = (batch.column(1).to_numpy(), bucket[term], sign[term] * batch.column(3).to_numpy())
            cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
            for a, b in zip(cuts, cuts[1:]):
                if files[a] != own:
                    yield from _summed(held, dimensions)
                    own, held = files[a], []
                held.append([c[a:b].copy() for c in rows])
        yield from _summed(held, dimensions)

    # Only where the next file begins is asked of the path: a number of eight bytes tells as well.
    found = post.filter("doc_id IS NOT NULL").select(F.xxhash64("file"), "doc_id", "term", "tf").mapInArrow(run, "doc_id long, vec array<float>")
    blank = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("vec", blank).alias("vec"))


def _hashed(terms: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sign) of each term, as in ``embed_postings``."""
    digests = np.frombuffer(b"".join(hashlib.md5(t.encode(), usedforsecurity=False).digest()[:5] for t in terms), np.uint8).reshape(-1, 5)
    bucket = digests[:, :4].copy().view(">u4")[:, 0] % dimensions
    return bucket.astype(np.int32), np.where(digests[:, 4] < 0x80, 1, -1)


def _summed(held: list, dimensions: int) -> Iterator[pa.RecordBatch]:
    """Unit vectors of the documents of a file from its (doc_id, bucket, signed count) rows."""
    if not held:
        return
    docs, bucket, signed = (np.concatenate(c) for c in zip(*held))
    ids, row = np.unique(docs, return_inverse=True)
    sums = np.bincount(row * dimensions + bucket, signed, len(ids) * dimensions).reshape(-1, dimensions)
    for low in range(0, len(ids), VECTOR_ROWS):
        part = sums[low : low + VECTOR_ROWS]
        norm = np.sqrt((part * part).sum(axis=1, keepdims=True))
        unit = (part / np.where(norm > 0, norm, 1)).astype(np.float32)
        ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * dimensions)
        yield pa.RecordBatch.from_arrays([pa.array(ids[low : low + VECTOR_ROWS]), pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))], ["doc_id", "vec"])


def encode(
    docs: DataFrame,
    load_model: Callable[[], Callable[[list[str]], np.ndarray]],
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_size: int = 64,
) -> DataFrame:
    """Vectors from any model: ``load_model`` runs once per task and returns ``texts -> (N, D)``.

    Vectors come back as L2-normalised float32.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                vectors = np.asarray(model(part["text"].tolist()), dtype=np.float64)
                norm = np.linalg.norm(vectors, axis=1, keepdims=True)
                unit = (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "vec": list(unit)})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInPandas(run, "doc_id long, vec array<float>")


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _ranked_batch(best: BestK, query_ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[best.owner]), pa.array(best.ids), pa.array(best.scores)],
        names=["query_id", "doc_id", "score"],
    )


def score_best(
    vectors: DataFrame, queries: DataFrame, k: int, max_broadcast_bytes: int = BROADCAST_MAX_BYTES
) -> DataFrame:
    """Per-task best ``k`` by inner product for each question; merge with ``top_k``.

    Question vectors are stored once and shipped to every task in blocks under the bound; the document vectors are
    streamed where they lie, once for each block: no shuffle but the few best rows.
    """
    return by_question_blocks(queries.select("query_id", "vec"), max_broadcast_bytes, lambda block: _by_broadcast(vectors, block, k))


def _by_broadcast(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    table = queries.select("query_id", "vec").toArrow().combine_chunks()
    ids = table.column("query_id").to_numpy()
    matrix = _matrix(table.column("vec").combine_chunks(), len(ids))
    shipped = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_matrix = shipped.value
        best = BestK(query_matrix, k)
        if len(query_ids):
            for batch in batches:
                if batch.num_rows:
                    best.add(batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows))
        yield _ranked_batch(best, query_ids)

    return vectors.select("doc_id", "vec").mapInArrow(run, RANKED)


def search(vectors: DataFrame, queries: DataFrame, k: int = fixed.DENSE_TOP_K, **options) -> DataFrame:
    """Exact top ``k`` documents per question by inner product; fewer than ``k`` documents give fewer rows."""
    return top_k(score_best(vectors, queries, k, **options), k)
