"""Answering a table of questions: hybrid retrieval, contexts, prompts, suggested questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowquarry.functions import fixed
from rowquarry.functions.text import classify, context_size, joined_in_order
from rowquarry.operators import bm25, dense, fusion
from rowquarry.operators.sieve import sieve
from rowquarry.session import materialise
from rowquarry.sources.index_io import RetrievalIndex

# Narrow rows (ids, ranks, scores) that may be broadcast, about 64 bytes each.
BROADCAST_MAX_ROWS = 1_000_000


def typed_questions(queries: DataFrame) -> DataFrame:
    """Questions with their type and the number of chunks each gets."""
    typed = queries.withColumn("qtype", classify(F.col("text")))
    return typed.withColumn("k", context_size(F.col("qtype")))


def hash_questions(queries: DataFrame) -> DataFrame:
    return dense.hash_embed(queries, "query_id").withColumnRenamed("doc_id", "query_id")


def hybrid_retrieve(
    index: RetrievalIndex,
    queries: DataFrame,
    embed: Callable[[DataFrame], DataFrame] = hash_questions,
    bm25_k: int = fixed.BM25_TOP_K,
    dense_k: int = fixed.DENSE_TOP_K,
    relevance_share: float = fixed.RETRIEVE_MMR_LAMBDA,
) -> DataFrame:
    """``(query_id, rank, doc_id)``: keyword and vector lists, fused, cut to three candidates per
    pick, diversified. ``queries`` is ``(query_id, text)`` with an optional ``k`` per question.

    Runs small jobs that count and store the questions, to decide what may be broadcast.
    """
    if "k" not in queries.columns:
        queries = queries.withColumn("k", F.lit(fixed.RETRIEVE_TOP_K))
    few = queries.count() * fixed.ANALYTICAL_TOP_K * fixed.CANDIDATES_PER_PICK <= BROADCAST_MAX_ROWS
    asked = materialise(embed(queries.select("query_id", "text")), "question-vectors")  # encoded once, used twice
    keyword = bm25.search(index.keyword, queries, bm25_k)
    nearest = dense.search(index.vectors, asked, dense_k)
    fused = fusion.fuse([keyword, nearest]).join(_maybe_broadcast(queries.select("query_id", "k"), few), "query_id")
    candidates = fusion.best_fused(fused, F.col("k") * fixed.CANDIDATES_PER_PICK)
    with_vectors = index.vectors.join(_maybe_broadcast(candidates.select("query_id", "doc_id", "rank"), few), "doc_id")
    return fusion.diversify(
        with_vectors, asked.join(queries.select("query_id", "k"), "query_id"), relevance_share, picks="k"
    )


def gather(picks: DataFrame, docs: DataFrame, few: bool) -> DataFrame:
    """Picked chunks with their text. With many questions both sides shuffle on ``doc_id``, but of the chunks only those
    that pass a filter of the picked ids: text that nobody picked stays where it is. A chunk that a third of the questions
    picked is then split by adaptive skew handling. Runs two jobs that store the picks and the filter if they are many."""
    if few:
        return docs.join(F.broadcast(picks), "doc_id")
    picks = materialise(picks, "picks")
    ids = materialise(picks.select("doc_id").distinct(), "picked-ids")
    return docs.filter(sieve(ids, "doc_id", ids.count())).join(picks, "doc_id")


def _maybe_broadcast(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def contexts(index: RetrievalIndex, queries: DataFrame, **options) -> DataFrame:
    """``(query_id, qtype, text, context)``: the retrieved chunks of each question as numbered
    sections. ``index.docs`` must carry ``chunk_type`` and ``table``. A question that finds
    nothing gets a fixed sentence."""
    questions = typed_questions(queries)
    few = questions.count() * fixed.ANALYTICAL_TOP_K <= BROADCAST_MAX_ROWS
    picks = hybrid_retrieve(index, questions, **options)
    chunks = gather(picks, index.docs, few)
    section = F.concat(
        F.format_string("[Context %d | type=%s table=%s]\n", F.col("rank"), F.col("chunk_type"), F.col("table")), F.col("text")
    )
    joined = chunks.groupBy("query_id").agg(joined_in_order(F.col("rank"), section, fixed.CONTEXT_SEPARATOR).alias("context"))
    return questions.join(joined, "query_id", "left").select(
        "query_id", "qtype", "text", F.coalesce("context", F.lit(fixed.NO_CONTEXT)).alias("context")
    )


def user_prompt(qtype: Column, context: Column, question: Column) -> Column:
    return F.concat(
        F.lit("[Query type: "), qtype, F.lit("]\n\nRETRIEVED CONTEXT:\n"), context, F.lit("\n\nUSER QUESTION: "), question
    )


def prompts(index: RetrievalIndex, queries: DataFrame, **options) -> DataFrame:
    """``(query_id, qtype, context, prompt)``, ready to write for any batch inference job."""
    found = contexts(index, queries, **options)
    return found.select("query_id", "qtype", "context", user_prompt(F.col("qtype"), F.col("context"), F.col("text")).alias("prompt"))


def system_text(description: str, summary: DataFrame) -> DataFrame:
    """One row ``system``: standing instructions with the purpose and the table summary."""
    return summary.select(
        F.concat(
            F.lit("You answer questions about the tables below.\n\nPurpose:\n" + description + "\n\nTables:\n"),
            F.col("summary"),
            F.lit(
                "\n\nRules:\n"
                "- Rely on the retrieved context alone, and say when it does not hold the answer.\n"
                "- Compute and compare when asked to analyse; quote records when asked to look them up.\n"
                "- Name the table and column an answer comes from, and lay out comparisons as tables.\n"
            ),
        ).alias("system")
    )


def extract_questions(completions: DataFrame, n: int = 5, text_col: str = "text") -> DataFrame:
    """Adds ``questions``: the first JSON array in the text, else its lines with a question
    mark less leading numbering, else the default questions; at most ``n``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    listed = F.from_json(F.regexp_extract(text, r"(?s)\[.*?\]", 0), "array<string>")
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda line: line.contains("?"))
    asked = F.transform(lines, lambda line: F.regexp_replace(F.regexp_replace(line, r"^\s+|\s+$", ""), r"^[0-9.) -]+", ""))
    defaults = F.array(*[F.lit(q) for q in fixed.DEFAULT_QUESTIONS])
    return completions.withColumn(
        "questions",
        F.when(listed.isNotNull(), F.slice(listed, 1, n)).when(F.size(asked) > 0, F.slice(asked, 1, n)).otherwise(defaults),
    )
