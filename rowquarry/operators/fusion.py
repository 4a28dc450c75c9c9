"""Fusing ranked lists and diversifying the fused candidates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowquarry.functions import fixed
from rowquarry.functions.kernels import spread_picks
from rowquarry.operators.ranking import keep_best, stable
from rowquarry.session import fits_broadcast, materialise

# Cells of the candidates' vectors that are solved at once.
MAX_CELLS = 4_000_000


def fuse(lists: list[DataFrame], rank_offset: int = fixed.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of any number of ranked lists.

    Gives ``(query_id, doc_id, score, rank_0, rank_1, …)``: the sum over lists of
    ``1 / (offset + rank)`` and the rank in each list, null where absent. A document in
    both lists meets itself in one grouping, which is the full outer join of the lists.
    """
    tagged = [
        ranked.select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.lit(i).alias("source"))
        for i, ranked in enumerate(lists)
    ]
    ranks = [F.min(F.when(F.col("source") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(lists))]
    merged = reduce(DataFrame.unionByName, tagged).groupBy("query_id", "doc_id").agg(*ranks)
    parts = [F.coalesce(F.lit(1.0) / (F.lit(rank_offset) + F.col(f"rank_{i}")), F.lit(0.0)) for i in range(len(lists))]
    return merged.select("query_id", "doc_id", reduce(lambda a, b: a + b, parts).alias("score"), *[f"rank_{i}" for i in range(len(lists))])


def best_fused(fused: DataFrame, k: int | Column) -> DataFrame:
    """The ``k`` best fused candidates per question. Ties keep the order of the first list,
    then of the next."""
    ranks = [F.col(c).asc_nulls_last() for c in fused.columns if c.startswith("rank_")]
    return keep_best(fused, [stable(F.col("score")).desc(), *ranks, F.col("doc_id").asc()], k)


def attach_vectors(candidates: DataFrame, vectors: DataFrame) -> DataFrame:
    """Candidates with their document vector. Stores the candidates and measures their size (two jobs), so that
    the search behind them runs once: under the bound they are broadcast and the vector table is only scanned."""
    candidates = materialise(candidates, "candidates")
    small = F.broadcast(candidates) if fits_broadcast(candidates) else candidates
    return vectors.join(small, "doc_id")


def diversify(
    candidates: DataFrame,
    queries: DataFrame,
    relevance_share: float = fixed.MMR_LAMBDA,
    picks: int | str = fixed.RETRIEVE_TOP_K,
) -> DataFrame:
    """Maximal marginal relevance per question: ``(query_id, doc_id, rank)`` in pick order.

    ``candidates`` is ``(query_id, doc_id, vec, rank)`` with ``rank`` the fused order;
    ``queries`` is ``(query_id, vec)`` plus the column named by ``picks`` when that is a string.
    A question's candidates are a bounded list (three per pick), held in one row; as many questions as
    fit a bounded block are solved at once.
    """
    lists = candidates.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "doc_id", "vec"))).alias("list")
    )
    wanted = F.col(picks).cast("int") if isinstance(picks, str) else F.lit(picks)
    asked = queries.select("query_id", F.col("vec").alias("query_vec"), wanted.alias("picks"))
    solved = lists.join(asked, "query_id").select(
        "query_id",
        F.transform("list", lambda c: c["doc_id"]).alias("ids"),
        _picker(relevance_share)(
            F.col("query_vec"), F.flatten(F.transform("list", lambda c: c["vec"])), F.size("list"), F.col("picks")
        ).alias("chosen"),
    )
    return solved.select("query_id", "ids", F.posexplode("chosen").alias("at", "pick")).select(
        "query_id",
        F.element_at("ids", F.col("pick") + 1).alias("doc_id"),
        (F.col("at") + 1).alias("rank"),
    )


def _picker(relevance_share: float):
    @F.pandas_udf("array<int>")
    def chosen(query: pd.Series, flat: pd.Series, count: pd.Series, picks: pd.Series) -> pd.Series:
        if not len(query):
            return pd.Series([], dtype=object)
        step = max(1, MAX_CELLS // max(1, int(count.max()) * len(query.iloc[0])))
        parts = [slice(low, low + step) for low in range(0, len(query), step)]
        solved = [_solve(query[p], flat[p], count[p], picks[p], relevance_share) for p in parts]
        return pd.Series([row for part in solved for row in part])

    return chosen


def _solve(query: pd.Series, flat: pd.Series, count: pd.Series, picks: pd.Series, relevance_share: float) -> list[np.ndarray]:
    """Picks of a few questions, whose candidate vectors fit in memory side by side."""
    vectors = np.stack(query.to_numpy()).astype(np.float64)
    width, dims = int(count.max()), vectors.shape[1]
    block = np.zeros((len(query), width, dims))
    valid = np.zeros((len(query), width), dtype=bool)
    for i, (values, size) in enumerate(zip(flat, count)):
        block[i, :size] = np.asarray(values, dtype=np.float64).reshape(size, dims)
        valid[i, :size] = True
    result = spread_picks(vectors, block, valid, picks.to_numpy(), relevance_share)
    return [row[row >= 0].astype(np.int32) for row in result]
