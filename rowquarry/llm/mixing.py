"""Mixing sources to target weights by fitting each source's word budget.

Sources in order of code point, null last, take the weights in turn. Together they share a multiple of all words;
a source stops at a multiple of its own size and the excess is shared again by weight. A source takes all its
documents as often as its target allows; the rest of its budget is fitted on the number of documents of each exact
length: most in proportion to the lengths there are, the last part by bounded-knapsack dynamic programming. Which
documents of a length are taken is decided by a seeded hash, so reruns agree.

Defined results: a null text has size 0; documents of size 0 take 0 words; repeated rows are rows of their own and
are interchangeable; a null source is a source; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.llm import texts
from rowquarry.session import fits_broadcast, materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2.0  # of a source's own words
SEED = 20
BUCKET_ROWS = 5000  # documents of one source and length that one task ranks, about


def targets(sizes: dict, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict:
    """Word target of each source: {source: words}."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: most * sizes[s] for s in above}
        left -= sum(out[s] for s in above)
        free = [s for s in free if s not in out]
    return out


def fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near below ``budget`` as can be found.

    Long lengths first, in proportion to what there is, up to a rest of about two of the longest documents; that
    rest exactly, by reachable sums over what is left of each length."""
    order = np.argsort(-lengths, kind="stable")
    lengths_down, left = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    taken = np.zeros(len(order), np.int64)
    total = int((lengths_down * left).sum())
    budget = min(int(budget), total)
    if budget <= 0:
        return taken
    if budget == total:
        taken[:] = left
    else:
        first = max(0, budget - 2 * int(lengths_down[0]))
        ideal = used = 0.0
        for k, (length, n) in enumerate(zip(lengths_down, left)):
            ideal += first / total * length * n
            taken[k] = min(n, max(0, int((ideal - used) // length)))
            used += taken[k] * length
        rest = budget - int((taken * lengths_down).sum())
        reached = np.zeros(rest + 1, bool)
        reached[0] = True
        by = np.full(rest + 1, -1, np.int64)
        for k in range(len(order) - 1, -1, -1):
            length = int(lengths_down[k])
            edge = reached.copy()
            for _ in range(int(left[k] - taken[k])):
                if length > rest or reached[rest]:
                    break
                new = np.zeros(rest + 1, bool)
                new[length:] = edge[:-length]
                edge = new & ~reached
                if not edge.any():
                    break
                reached |= edge
                by[edge] = k
            if reached[rest]:
                break
        at = int(np.flatnonzero(reached)[-1])
        while at:
            taken[by[at]] += 1
            at -= int(lengths_down[by[at]])
    out = np.zeros(len(order), np.int64)
    out[order] = taken
    return out


def sizes(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the number of words of each row."""
    schema = T.StructType([docs.select(*keep).schema[k] for k in keep]).add("size", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in texts.blocks(batches, "__text", 4 << 20, 10_000):
            n = part.num_rows
            counted = np.bincount(texts.owner(at, texts.words(data, at)[0]), minlength=n) if len(data) else np.zeros(n, np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(counted.astype(np.int64))], schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    found: Column = F.lit(True)
    for key in keys:
        found = found & a[key].eqNullSafe(b[key])
    return found


def _attach(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    joined = rows.join(F.broadcast(few) if fits_broadcast(few) else few, _same(rows, few, keys), how)
    for key in keys:
        joined = joined.drop(few[key])
    return joined


def mix(sized: DataFrame, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``sized`` (key, source, size; stored, as it is read several times) with source_size, target and taken.

    The driver sees one row per source. Documents of one source and length are dealt over buckets by their hash,
    so the ranking of a length that a third of all documents have is spread over many tasks."""
    of_source = sized.groupBy("source").agg(F.sum("size").alias("words"))
    totals = {r["source"]: int(r["words"]) for r in of_source.collect()}
    aims = targets(totals)
    spark = sized.sparkSession
    kind = sized.schema["source"].dataType
    known = T.StructType().add("source", kind).add("source_size", "long").add("target", "double").add("whole", "long").add("budget", "long")
    listed = []
    for source, words in totals.items():
        whole = int(aims[source] // words) if words else 0
        listed.append((source, words, float(aims[source]), whole, int(round(aims[source] - whole * words))))
    sources = spark.createDataFrame(listed, known)
    histogram = sized.groupBy("source", "size").agg(F.count("*").alias("n"))

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        usable = frame["size"].to_numpy() > 0
        extra = np.zeros(len(frame), np.int64)
        if usable.any():
            extra[usable] = fill(frame["size"].to_numpy()[usable], frame["n"].to_numpy()[usable], int(frame["budget"].iloc[0]))
        return frame.assign(extra=extra, buckets=-(-frame["n"] // BUCKET_ROWS))

    with_budget = _attach(histogram, sources, ["source"])
    wanted = T.StructType([*with_budget.schema.fields]).add("extra", "long").add("buckets", "long")
    planned = materialise(with_budget.groupBy("source").applyInPandas(plan, wanted), "mix-plan").drop("n", "budget")
    rows = _attach(sized, planned, ["source", "size"])
    rows = rows.withColumn("__draw", F.xxhash64(F.lit(seed), F.col(key)))
    rows = rows.withColumn("__bucket", F.pmod(F.shiftright("__draw", 20), F.col("buckets")))
    crowded = rows.filter("buckets > 1").groupBy("source", "size", "__bucket").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("source", "size").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(crowded.select("source", "size", "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before")), "mix-before")
    rows = _attach(rows, before, ["source", "size", "__bucket"], "left")
    place = F.row_number().over(Window.partitionBy("source", "size", "__bucket").orderBy("__draw", key))
    chosen = (place + F.coalesce(F.col("__before"), F.lit(0))) <= F.col("extra")
    return rows.withColumn("taken", F.col("size") * (F.col("whole") + chosen.cast("long"))).select(
        *sized.columns, "source_size", "target", "taken", (F.col("whole") + chosen.cast("long")).alias("copies")
    )


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them. Ids should be unique; rows that
    share one are taken as often as the one taken most. Columns may have any names."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    own, kind = f"c{names.index(key)}", f"c{names.index(source)}"
    sized = materialise(sizes(plain.select(F.col(own).alias("id"), F.col(kind).alias("source"), F.col(f"c{names.index(text)}").alias("text")), ["id", "source"]), "mix-sizes")
    taken = mix(sized, "id", seed).filter("copies > 0").groupBy("id").agg(F.max("copies").alias("copies"))
    taken = materialise(taken, "mix-taken")
    joined = plain.join(F.broadcast(taken) if fits_broadcast(taken) else taken, plain[own].eqNullSafe(taken["id"]))
    repeated = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*plain.columns).toDF(*names)
