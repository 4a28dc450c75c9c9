"""Column profiles, describe statistics and most frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.functions import fixed
from rowquarry.functions.text import cell_sql, name_sql, text_sql
from rowquarry.operators.ranking import keep_best
from rowquarry.operators.rows import ROW_ID, NumberedTable
from rowquarry.session import materialise

PROFILE_SCHEMA = (
    "col_ord int, column string, dtype string, unique_count long, null_count long, "
    "sample_values array<string>, min double, max double, mean double"
)


def dtype_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int64"
    if isinstance(dtype, T.NumericType):
        return "float64"
    return "object"


def is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def long_form(rows: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """One row per cell: ``(col_ord, whole, decimal, text, __row_id)``, typed so that equal
    means equal in the column's own type. Built inside the row, no shuffle."""
    typed = []
    for i, f in enumerate(fields):
        name, kind = name_sql(f.name), dtype_name(f.dataType)
        whole = f"bigint({name})" if kind in ("int64", "bool") else "bigint(null)"
        decimal = f"double({name})" if kind == "float64" else "double(null)"
        text = cell_sql(name, f.dataType) if kind == "object" else "string(null)"
        typed.append(
            f"struct({i} AS col_ord, {whole} AS whole, {decimal} AS decimal, {text} AS text, {name} IS NULL AS missing)"
        )
    keep = [ROW_ID] if ROW_ID in rows.columns else []
    cells = rows.selectExpr(f"inline(array({', '.join(typed)}))", *keep)
    return cells.filter("NOT missing").drop("missing")


def value_counts(rows: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """``(col_ord, whole, decimal, text, n, first_row)``: every distinct value of every column.

    One shuffle for all columns; a value filling a third of the table is one record per task.
    """
    measures = [F.count(F.lit(1)).alias("n")]
    if ROW_ID in rows.columns:
        measures.append(F.min(ROW_ID).alias("first_row"))
    return long_form(rows, fields).groupBy("col_ord", "whole", "decimal", "text").agg(*measures)


def _column_measures(rows: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Null count, min, max and mean of every column from one aggregate, one row per column."""
    measures, per_column = [], []
    for i, f in enumerate(fields):
        name, kind = name_sql(f.name), dtype_name(f.dataType)
        empty = f"{name} IS NULL" + (f" OR {name} = ''" if isinstance(f.dataType, T.StringType) else "")
        measures.append(f"count_if({empty}) AS nulls_{i}")
        shape = "double(null) AS min, double(null) AS max, double(null) AS mean"
        if kind != "object":
            number = f"bigint({name})" if kind == "bool" else name
            measures += [f"min({number}) AS min_{i}", f"max({number}) AS max_{i}", f"avg({number}) AS mean_{i}"]
            shape = f"double(min_{i}) AS min, double(max_{i}) AS max, bround(mean_{i}, 4) AS mean"
        per_column.append(
            f"struct({i} AS col_ord, {text_sql(f.name)} AS column, '{kind}' AS dtype, nulls_{i} AS null_count, {shape})"
        )
    return rows.selectExpr(*measures).selectExpr(f"inline(array({', '.join(per_column)}))")


def samples(table: NumberedTable) -> DataFrame:
    """First values of every column in row order: at most five rows are read."""
    first = table.at(list(range(fixed.SAMPLE_VALUES)))
    cells = ", ".join(cell_sql(name_sql(f.name), f.dataType) for f in table.fields)
    few = first.selectExpr(f"{ROW_ID} AS row", f"posexplode(array({cells})) AS (col_ord, value)")
    return few.groupBy("col_ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda p: p["value"]).alias("sample_values")
    )


def profile(table: NumberedTable, approx: bool = False) -> DataFrame:
    """One row per column: type, distinct values, empty cells, first values, range and mean.

    ``approx`` swaps the exact distinct count (one shuffle of all distinct values) for a sketch.
    """
    fields = table.fields
    if approx:
        sketch = table.rows.selectExpr(*[f"approx_count_distinct({name_sql(f.name)}) AS u_{i}" for i, f in enumerate(fields)])
        each = ", ".join(f"struct({i} AS col_ord, u_{i} AS unique_count)" for i in range(len(fields)))
        uniques = sketch.selectExpr(f"inline(array({each}))")
    else:
        uniques = value_counts(table.rows, fields).groupBy("col_ord").agg(F.count(F.lit(1)).alias("unique_count"))
    # All three sides have one row per column.
    return (
        _column_measures(table.rows, fields)
        .join(F.broadcast(uniques), "col_ord", "left")
        .join(F.broadcast(samples(table)), "col_ord", "left")
        .select(
            "col_ord",
            "column",
            "dtype",
            F.coalesce("unique_count", F.lit(0)).cast("long").alias("unique_count"),
            "null_count",
            F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
            "min",
            "max",
            "mean",
        )
    )


def quantiles(rows: DataFrame, names: list[str], shares: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: ``(col_ord, share, value)``. Runs jobs, see ``quantiles_of_counts``."""
    numbers = ", ".join(f"struct({i} AS col_ord, double({name_sql(c)}) AS v)" for i, c in enumerate(names))
    cells = rows.selectExpr(f"inline(array({numbers}))").filter("v IS NOT NULL")
    return quantiles_of_counts(cells.groupBy("col_ord", "v").agg(F.count(F.lit(1)).alias("n")), shares)


def quantiles_of_counts(counted: DataFrame, shares: list[float]) -> DataFrame:
    """``(col_ord, share, value)`` from ``counted(col_ord, v, n)``. Runs jobs.

    Distinct values with their counts are range-partitioned by (column, value) and written;
    the rows before each partition give every partition its starting rank, so the wanted
    ranks are found in the few partitions that hold them. No task gathers a whole column.
    """
    spark = counted.sparkSession
    written = materialise(
        counted.repartitionByRange("col_ord", "v").withColumn("__part", F.spark_partition_id()), "quantiles"
    )
    totals = written.groupBy("col_ord", "__part").agg(F.sum("n").alias("n")).collect()  # one row per partition and column
    before, column_total = {}, {}
    for row in sorted(totals, key=lambda r: (r["col_ord"], r["__part"])):
        seen = column_total.get(row["col_ord"], 0)
        before[(row["col_ord"], row["__part"])] = (seen, seen + row["n"])
        column_total[row["col_ord"]] = seen + row["n"]
    wanted = []
    for col_ord, total in column_total.items():
        for share in shares:
            place = share * (total - 1)
            low = int(place)
            for rank, part_of in ((low, 1 - (place - low)), (min(low + 1, total - 1), place - low)):
                for (c, part), (start, end) in before.items():
                    if c == col_ord and start <= rank < end:
                        wanted.append((col_ord, share, part, rank - start, float(part_of)))
    schema = "col_ord int, share double, __part int, rank long, weight double"
    asked = spark.createDataFrame(wanted, schema)  # two rows per column and share
    parts = sorted({w[2] for w in wanted})
    window = Window.partitionBy("__part", "col_ord").orderBy("v")
    running = (
        written.filter(F.col("__part").isin(parts))
        .withColumn("upto", F.sum("n").over(window))
        .withColumn("from", F.col("upto") - F.col("n"))
    )
    found = running.join(F.broadcast(asked), ["col_ord", "__part"]).filter(
        (F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto"))
    )
    return found.groupBy("col_ord", "share").agg(F.sum(F.col("v") * F.col("weight")).alias("value"))


def describe(rows: DataFrame, names: list[str], approx: bool = False) -> DataFrame:
    """``(col_ord, column, count, mean, std, min, p25, p50, p75, max)``, rounded to 3 digits.

    Exact quartiles run jobs (see ``quantiles``); ``approx`` uses a sketch in the same pass.
    """
    measures, per_column = [], []
    for i, c in enumerate(names):
        x = f"double({name_sql(c)})"
        measures += [f"count({x}) AS count_{i}", f"avg({x}) AS mean_{i}", f"stddev_samp({x}) AS std_{i}"]
        measures += [f"min({x}) AS min_{i}", f"max({x}) AS max_{i}"]
        shape = ", ".join(f"{m}_{i} AS {m}" for m in ("count", "mean", "std", "min", "max"))
        if approx:
            measures.append(f"percentile_approx({x}, array(0.25, 0.5, 0.75)) AS q_{i}")
            shape += f", q_{i} AS q"
        per_column.append(f"struct({i} AS col_ord, {text_sql(c)} AS column, {shape})")
    plain = rows.selectExpr(*measures).selectExpr(f"inline(array({', '.join(per_column)}))")
    if approx:
        joined = plain.select("*", *[F.col("q")[j].alias(f"p{p}") for j, p in enumerate((25, 50, 75))])
    else:
        wide_q = quantiles(rows, names, [0.25, 0.5, 0.75]).groupBy("col_ord").agg(
            *[F.max(F.when(F.col("share") == s, F.col("value"))).alias(f"p{int(s * 100)}") for s in (0.25, 0.5, 0.75)]
        )
        joined = plain.join(F.broadcast(wide_q), "col_ord", "left")  # one row per column
    return joined.select(
        "col_ord", "column", "count", *[F.bround(m, 3).alias(m) for m in ("mean", "std", "min", "p25", "p50", "p75", "max")]
    )


def top_values(table: NumberedTable, columns: int = fixed.TEXT_COLUMNS_SUMMARISED, k: int = fixed.TOP_VALUES) -> DataFrame:
    """``(col_ord, column, value, n, rank)``: most frequent values of the first text columns,
    equals in order of first appearance. ``col_ord`` is the column's place in the table."""
    places = [i for i, f in enumerate(table.fields) if dtype_name(f.dataType) == "object"][:columns]
    fields = [table.fields[i] for i in places]
    if not fields:
        return table.rows.sparkSession.createDataFrame([], "col_ord int, column string, value string, n long, rank int")
    counted = value_counts(table.rows, fields)
    best = keep_best(counted, [F.col("n").desc(), F.col("first_row").asc()], k, group="col_ord")
    names = F.array(*[F.lit(f.name) for f in fields])
    ords = F.array(*[F.lit(i) for i in places])
    return best.select(
        F.element_at(ords, F.col("col_ord") + 1).alias("col_ord"),
        F.element_at(names, F.col("col_ord") + 1).alias("column"),
        F.col("text").alias("value"),
        "n",
        "rank",
    )
