"""Ranked lists: ``(query_id, doc_id, score, rank)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.session import materialise, measured_size, scratch_path

RANKED = T.StructType().add("query_id", "long").add("doc_id", "long").add("score", "double")
SCORE_DIGITS = 9  # scores equal to this many digits count as tied


def stable(score: Column) -> Column:
    """Score as compared: float sums may differ in their last bits between runs."""
    return F.round(score, SCORE_DIGITS)


def keep_best(df: DataFrame, order: list[Column], k: int | Column, group: str = "query_id") -> DataFrame:
    """The ``k`` first rows of each group in ``order``, numbered from 1 in ``rank``.

    Spark turns the rank filter into a per-partition limit before the shuffle, so each task
    sends at most ``k`` rows per group.
    """
    window = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(window))
    return ranked.filter(F.col("rank") <= k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Best ``k`` documents per query: score descending, then document id."""
    return keep_best(scored, [stable(F.col("score")).desc(), F.col("doc_id").asc()], k)


def by_question_blocks(asked: DataFrame, max_bytes: int, rank: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rank`` over blocks of whole questions of at most about ``max_bytes``, so that each block can be sent to
    every task while the corpus stays where it lies.

    Stores and measures ``asked`` (two small jobs). One block is ranked lazily; more are ranked one after the other,
    each in a pass over the corpus, and their few best rows are kept in the shared folder.
    """
    asked = materialise(asked, "asked")
    rows, size = measured_size(asked)
    blocks = max(1, min(rows, -(-size // max(1, max_bytes))))
    if blocks == 1:
        return rank(asked)
    spark, folder = asked.sparkSession, scratch_path(asked.sparkSession, "ranked")
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rank(own).write.parquet(f"{folder}/block={b}")
    return spark.read.schema(RANKED).parquet(folder).select(*RANKED.names)
