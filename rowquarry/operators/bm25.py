"""Keyword index and BM25 search over a batch of questions.

Index tables: ``postings(doc_id, term, tf, dl)``, ``terms(term, df, idf)``, one-row
``stats(n, total, avgdl)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowquarry.functions import fixed
from rowquarry.functions.text import tokenise
from rowquarry.functions.kernels import BestWeighted
from rowquarry.operators.ranking import RANKED, by_question_blocks, top_k
from rowquarry.session import fits_broadcast

# Question weights that are sent to every task at once.
QUESTION_BLOCK_BYTES = 32 * 1024 * 1024
TASK_BYTES = 16 << 20  # of text whose words one task counts


@dataclass(frozen=True)
class KeywordIndex:
    postings: DataFrame
    stats: DataFrame
    terms: DataFrame | None = None  # None: document frequencies are counted for the asked terms only
    by_document: bool = False  # postings are already hash-partitioned on doc_id
    by_file: bool = False  # postings name their ``file``, which holds all of a document's and is read by one task


def text_parts(docs: DataFrame, text_col: str = "text") -> int | None:
    """In how many parts a corpus is dealt, so that a task's words take the same memory whatever its size; None if it is
    one task's. Runs one job that adds up the lengths."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)) if size > TASK_BYTES else None


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """``(doc_id, tokens)`` hash-partitioned on ``doc_id``, in exactly ``partitions`` parts if given, else by ``text_parts``.

    This is the only full-corpus shuffle: counting terms per document and scoring per
    (question, document) both group on ``doc_id`` and so stay inside the partition. The raw
    text travels, not the tokens: token arrays are several times larger.
    """
    partitions = partitions or text_parts(docs, text_col)
    placed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = placed.repartition(partitions, "doc_id") if partitions else placed.repartition("doc_id")
    return placed.select("doc_id", tokenise(F.col("text")).alias("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    """One row per (document, term): count of the term and length of the document."""
    sized = tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"), "tokens")
    # explode_outer plus a later filter: with plain explode the optimiser would copy the
    # tokeniser into a filter below the shuffle and run it twice.
    exploded = sized.select("doc_id", "dl", F.explode_outer("tokens").alias("term")).filter(F.col("term").isNotNull())
    return exploded.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """Number of documents (empty ones too) and their mean length."""
    return tokens.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long").alias("total")
    ).withColumn("avgdl", F.col("total") / F.greatest(F.col("n"), F.lit(1)))


def totals(docs: DataFrame, post: DataFrame) -> DataFrame:
    """``corpus_stats`` from written tables: term counts add up to the lengths, so no text is read."""
    return (
        post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
        .withColumn("n", docs.agg(F.count(F.lit(1))).scalar())
        .select("n", "total", (F.col("total") / F.greatest(F.col("n"), F.lit(1))).alias("avgdl"))
    )


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_stats(post: DataFrame, stats: DataFrame) -> DataFrame:
    """Documents per term and its weight."""
    counted = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.withColumn("idf", inverse_frequency(stats.select("n").scalar(), F.col("df")))


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> KeywordIndex:
    """Index of a corpus, lazy but for the job that measures its text; see ``sources.index_io`` for the written form."""
    tokens = tokenised(docs, id_col, text_col)
    return KeywordIndex(postings(tokens), corpus_stats(tokens), None, by_document=True)


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """``(query_id, term, qtf)``: repeated words in a question count again."""
    return (
        queries.select(F.col(id_col).cast("long").alias("query_id"), F.explode(tokenise(F.col(text_col))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def contribution(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What one term adds to a document's score, before its weight."""
    length_norm = F.lit(1 - fixed.BM25_B) + fixed.BM25_B * dl / avgdl
    return tf * (fixed.BM25_K1 + 1) / (tf + fixed.BM25_K1 * length_norm)


def question_weights(index: KeywordIndex, asked: DataFrame) -> DataFrame:
    """``(query_id, term, weight)`` of the asked terms that the corpus has. Measures the terms first (one small job)."""
    wanted = asked.select("term").distinct()
    if fits_broadcast(wanted):
        wanted = F.broadcast(wanted)
    terms = index.terms
    if terms is None:
        terms = term_stats(index.postings.join(wanted, "term", "left_semi"), index.stats)
    return asked.join(terms, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))


def score_best(index: KeywordIndex, weights: DataFrame, k: int) -> DataFrame:
    """Per-task best ``k`` documents for each question of one block of ``weights``; merge with ``top_k``.

    The block travels to every task. The postings of asked terms are gathered per document, and each task adds up
    scores in NumPy and sends its best rows only: no row per (question, document) pair is ever made.
    """
    spark = weights.sparkSession
    table = weights.select("query_id", "term", "weight").toArrow().combine_chunks()
    query_ids, owner = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
    coded = table.column("term").combine_chunks().dictionary_encode()
    terms, number = coded.dictionary, coded.indices.to_numpy()
    order = np.lexsort((owner, number))
    cuts = np.searchsorted(number[order], np.arange(len(terms) + 1))
    shipped = spark.sparkContext.broadcast((query_ids, cuts, owner[order], table.column("weight").to_numpy()[order]))
    numbered = pa.table({"term": terms.cast(pa.string()), "number": pa.array(np.arange(len(terms), dtype=np.int32))})

    post = index.postings.join(F.broadcast(spark.createDataFrame(numbered, "term string, number int")), "term")
    avgdl = index.stats.select("avgdl").scalar()
    part = contribution(F.col("tf"), F.col("dl"), avgdl).alias("part")
    if index.by_file:
        return post.select(F.xxhash64("file"), "doc_id", "number", part).mapInArrow(_by_file(shipped, k), RANKED)
    post = post.select("doc_id", "number", part)
    if not index.by_document:
        post = post.repartition("doc_id")
    gathered = post.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "part"))).alias("hits"))  # a document's asked terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, *asked = shipped.value
        best = BestWeighted(len(ids), *asked, k)
        for batch in batches:
            if batch.num_rows and len(ids):
                offsets = np.concatenate([[0], np.cumsum(batch.column(1).value_lengths().to_numpy())])
                best.add(batch.column(0).to_numpy(), offsets, batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy())
        yield _ranked(ids, best)

    return gathered.select("doc_id", "hits.number", "hits.part").mapInArrow(run, RANKED)


def _ranked(ids: np.ndarray, best: BestWeighted) -> pa.RecordBatch:
    found = best.best
    return pa.RecordBatch.from_arrays([pa.array(ids[found.owner]), pa.array(found.ids), pa.array(found.scores)], RANKED.names)


def _by_file(shipped, k: int):
    """Scores the asked postings of a file once all of them have come; no more of them are held at a time. Questions that
    no document of the file can still enter, by the largest part of each term in it, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, *asked = shipped.value
        best, held, own = BestWeighted(len(ids), *asked, k), [], None

        def flush() -> None:
            if held:
                docs, terms, parts = (np.concatenate(c) for c in zip(*held))
                order = np.lexsort((terms, docs))
                names, first = np.unique(docs[order], return_index=True)
                best.add(names, np.append(first, len(docs)), terms[order], parts[order], bounded=True)
                held.clear()

        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            files = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(files)]
            for a, b in zip(cuts, cuts[1:]):
                if files[a] != own:
                    flush()
                    own = files[a]
                held.append([batch.column(c).slice(a, b - a).to_numpy() for c in (1, 2, 3)])
        flush()
        yield _ranked(ids, best)

    return run


def search(
    index: KeywordIndex, queries: DataFrame, k: int = fixed.BM25_TOP_K, max_block_bytes: int = QUESTION_BLOCK_BYTES
) -> DataFrame:
    """Top ``k`` documents per question (``query_id``, ``text``). Weighs the questions first, in small jobs."""
    weights = question_weights(index, query_terms(queries))
    return top_k(by_question_blocks(weights, max_block_bytes, lambda block: score_best(index, block, k)), k)
