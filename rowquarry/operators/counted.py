"""All statistics of all columns of all tables from one counting pass.

``measure`` counts every distinct value of every column of every table in one shuffle and stores the counts; distinct
values, empty cells, ranges, means, deviations, quartiles and most frequent values are all read from them. ``approx``
replaces the counts by sketches that are merged in a single aggregate, one row a column, whatever the number of values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowquarry.functions import fixed
from rowquarry.operators.profile import dtype_name, is_number, long_form, quantiles_of_counts, samples
from rowquarry.operators.ranking import keep_best
from rowquarry.operators.rows import ROW_ID, NumberedTable
from rowquarry.session import materialise

FEW_VALUES = 100_000  # up to so many distinct values, a column's quartiles come from one aggregate instead of a sort
SHARES = (0.25, 0.5, 0.75)
_MEASURES = (
    "table_ord int, col_ord int, column string, dtype string, is_number boolean, unique_count long, filled long, empty long, "
    "min double, max double, mean double, std double, p25 double, p50 double, p75 double"
)


@dataclass(frozen=True)
class Measures:
    """``columns``: one row per column, as in ``_MEASURES``. ``top``: (table_ord, col_ord, value, n, rank)."""

    tables: dict[str, NumberedTable]
    columns: list[tuple]
    top: DataFrame

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.columns, _MEASURES)


def _cells(tables: dict[str, NumberedTable]) -> DataFrame:
    parts = [long_form(t.rows, t.fields).select(F.lit(i).alias("table_ord"), "*") for i, t in enumerate(tables.values())]
    return reduce(DataFrame.union, parts).withColumn("v", F.coalesce("decimal", F.col("whole").cast("double")))


def _listed(tables: dict[str, NumberedTable]) -> list[tuple[int, int]]:
    """(table_ord, col_ord) of the text columns whose frequent values are listed: the first few of each table."""
    found = []
    for i, t in enumerate(tables.values()):
        places = [j for j, f in enumerate(t.fields) if dtype_name(f.dataType) == "object"]
        found += [(i, j) for j in places[: fixed.TEXT_COLUMNS_SUMMARISED]]
    return found


def _rows(tables: dict[str, NumberedTable], found: dict[tuple[int, int], tuple]) -> list[tuple]:
    rows = []
    for i, t in enumerate(tables.values()):
        for j, f in enumerate(t.fields):
            unique, filled, empty, *rest = found.get((i, j), (0, 0, 0, *[None] * 7))
            missing = t.n_rows - filled + empty
            rows.append((i, j, f.name, dtype_name(f.dataType), is_number(f), unique, filled, missing, *rest))
    return rows


def measure(tables: dict[str, NumberedTable], approx: bool = False) -> Measures:
    """Statistics of every column of ``tables``. Runs one counting job and two or three small ones for all tables
    together; with ``approx`` one job in all. The driver gets one row per column, without any text."""
    return _sketched(tables) if approx else _counted(tables)


def _counted(tables: dict[str, NumberedTable]) -> Measures:
    keys = ["table_ord", "col_ord"]
    cells = _cells(tables)
    counts = materialise(cells.groupBy(*keys, "v", "whole", "text").agg(F.count("*").alias("n"), F.min(ROW_ID).alias("first_row")), "value-counts")
    weight = F.sum(F.col("n") * F.col("v")) / F.sum(F.when(F.col("v").isNotNull(), F.col("n")))
    base = counts.groupBy(*keys).agg(
        F.count("*").alias("unique"), F.sum("n").alias("filled"), F.coalesce(F.sum(F.when(F.col("text") == "", F.col("n"))), F.lit(0)).alias("empty"),
        F.min("v").alias("min"), F.max("v").alias("max"), weight.alias("mean"),
    )
    first = {(r["table_ord"], r["col_ord"]): r for r in base.collect()}
    means = [(*k, r["mean"], r["unique"] <= FEW_VALUES) for k, r in first.items() if r["mean"] is not None]
    spread: dict[tuple[int, int], tuple] = {}
    if means:
        spark = counts.sparkSession
        numbers = counts.filter("v IS NOT NULL").join(F.broadcast(spark.createDataFrame(means, "table_ord int, col_ord int, mean double, few boolean")), keys)
        square = F.sum(F.col("n") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean")))
        few = F.expr(f"percentile(IF(few, v, NULL), array({', '.join(map(str, SHARES))}), n)").alias("q")
        for r in numbers.groupBy(*keys).agg(square.alias("square"), F.sum("n").alias("n"), few).collect():
            std = (r["square"] / (r["n"] - 1)) ** 0.5 if r["n"] > 1 else None
            spread[r["table_ord"], r["col_ord"]] = (std, *(r["q"] or (None,) * 3))
        if many := [m[:2] for m in means if not m[3]]:
            # Numbers of columns, and not the columns, are what the sort of the rest is keyed by.
            wanted = spark.createDataFrame([(*m, i) for i, m in enumerate(many)], "table_ord int, col_ord int, place int")
            sorted_out = numbers.join(F.broadcast(wanted), keys).select(F.col("place").alias("col_ord"), "v", "n")
            for r in quantiles_of_counts(sorted_out, list(SHARES)).collect():
                own = [*spread[many[r["col_ord"]]]]
                own[1 + SHARES.index(r["share"])] = r["value"]
                spread[many[r["col_ord"]]] = tuple(own)
    found = {k: (r["unique"], r["filled"], r["empty"], r["min"], r["max"], r["mean"], *spread.get(k, (None,) * 4)) for k, r in first.items()}
    listed = _listed(tables)
    if not listed:
        return Measures(tables, _rows(tables, found), counts.sparkSession.createDataFrame([], "table_ord int, col_ord int, value string, n long, rank int"))
    chosen = F.array(*[F.lit(f"{i}:{j}") for i, j in listed])
    texts = counts.withColumn("group", F.concat_ws(":", "table_ord", "col_ord")).filter(F.array_contains(chosen, F.col("group")))
    texts = texts.withColumn("value", F.col("text"))
    best = keep_best(texts, [F.col("n").desc(), F.col("first_row").asc()], fixed.TOP_VALUES, "group")
    return Measures(tables, _rows(tables, found), best.select("table_ord", "col_ord", "value", "n", "rank"))


def _sketched(tables: dict[str, NumberedTable]) -> Measures:
    cells = _cells(tables).withColumn("listed", F.concat_ws(":", "table_ord", "col_ord").isin([f"{i}:{j}" for i, j in _listed(tables)]))
    value = F.xxhash64("v", "whole", "text")
    sketch = cells.groupBy("table_ord", "col_ord").agg(
        F.approx_count_distinct(value).alias("unique"), F.count("*").alias("filled"), F.count_if(F.col("text") == "").alias("empty"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.percentile_approx("v", list(SHARES)).alias("q"),
        F.call_function("approx_top_k", F.when(F.col("listed"), F.col("text")), F.lit(fixed.TOP_VALUES)).alias("top"),
    )
    stored = materialise(sketch, "value-sketches")
    found = {
        (r["table_ord"], r["col_ord"]): (*[r[c] for c in ("unique", "filled", "empty", "min", "max", "mean", "std")], *(r["q"] or (None,) * 3))
        for r in stored.drop("top").collect()
    }
    top = stored.select("table_ord", "col_ord", F.posexplode("top").alias("at", "t"))
    top = top.select("table_ord", "col_ord", F.col("t.item").alias("value"), F.col("t.count").alias("n"), (F.col("at") + 1).alias("rank"))
    return Measures(tables, _rows(tables, found), top.filter("value IS NOT NULL"))


def profiles(measured: Measures) -> DataFrame:
    """``profile`` of every table at once, with ``table_ord``."""
    spark = measured.top.sparkSession
    first = [samples(t).select(F.lit(i).alias("table_ord"), "*") for i, t in enumerate(measured.tables.values())]
    kept = F.col("dtype") != "object"
    return (
        measured.frame(spark)
        .join(F.broadcast(reduce(DataFrame.union, first)), ["table_ord", "col_ord"], "left")  # a row a column
        .select(
            "table_ord", "col_ord", "column", "dtype", "unique_count", F.col("empty").alias("null_count"),
            F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
            *[F.when(kept, F.col(c)).alias(c) for c in ("min", "max")], F.when(kept, F.bround("mean", 4)).alias("mean"),
        )
    )


def descriptions(measured: Measures) -> DataFrame:
    """``describe`` of every table's number columns at once, with ``table_ord``."""
    frame = measured.frame(measured.top.sparkSession).filter("is_number")
    rounded = [F.bround(m, 3).alias(m) for m in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    return frame.select("table_ord", "col_ord", "column", F.col("filled").alias("count"), *rounded)
