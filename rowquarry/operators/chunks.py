"""Turning table rows into text chunks.

Content chunks are ``(col_group, window, row_start, row_end, cols, text)``; ``plans.build``
adds table names and chunk ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowquarry.functions import fixed
from rowquarry.functions.text import float_text, joined_in_order, row_line, short_cells
from rowquarry.operators.counted import Measures, descriptions, measure
from rowquarry.operators.rows import ROW_ID, NumberedTable, even_positions

STRATEGIES = tuple(fixed.DEFAULT_PARAMETERS)
BLOCK = 512  # windows that go to a task together


def window_step(window: int, overlap: int) -> int:
    return max(1, window - overlap)


def window_count(n_rows: int, window: int, overlap: int) -> int:
    return -(-n_rows // window_step(window, overlap))


def windows_of(row_id: Column, window: int, overlap: int) -> Column:
    """All windows a row is in. A window starts every ``step`` rows; with gaps between
    windows a row may be in none."""
    step = window_step(window, overlap)
    last = F.floor(row_id / step).cast("long")
    first = F.greatest(F.ceil((row_id - (window - 1)) / step), F.lit(0)).cast("long")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))


def column_groups(names: list, group_size: int) -> list[list]:
    return [names[i : i + group_size] for i in range(0, len(names), group_size)]


def _lit_array(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def _bounds(table: NumberedTable, window: int, overlap: int) -> list[Column]:
    start = F.col("window") * window_step(window, overlap)
    return [start.cast("long").alias("row_start"), F.least(start + window, F.lit(table.n_rows)).cast("long").alias("row_end")]


def row_window_chunks(table: NumberedTable, name: str, window: int = 10, overlap: int = 2) -> DataFrame:
    """Sliding windows over rows: one chunk per window.

    Each row is copied to the windows it is in (about ``window / step`` of them) and grouped
    by window, so a group never holds more than ``window`` lines.
    """
    lines = table.rows.select(ROW_ID, row_line(table.fields).alias("line")).withColumn(
        "window", F.explode(windows_of(F.col(ROW_ID), window, overlap))
    )
    bodies = lines.groupBy("window").agg(joined_in_order(F.col(ROW_ID), F.col("line"), "\n").alias("body"))
    sized = bodies.select("window", *_bounds(table, window, overlap), "body")
    header = F.format_string(f"[Table: {_escaped(name)} | Rows %d–%d of {table.n_rows}]\n", F.col("row_start") + 1, F.col("row_end"))
    return sized.select(
        F.lit(None).cast("int").alias("col_group"),
        "window",
        "row_start",
        "row_end",
        _lit_array(table.columns).alias("cols"),
        F.concat(header, F.col("body")).alias("text"),
    )


def column_group_chunks(table: NumberedTable, name: str, row_sample: int = 20, group_size: int = 8) -> DataFrame:
    """One chunk per group of columns, over a few evenly spread rows read by their numbers."""
    groups = column_groups(table.fields, group_size)
    few = table.at(even_positions(table.n_rows, row_sample))
    lines = few.select(ROW_ID, F.posexplode(F.array(*[row_line(g) for g in groups])).alias("col_group", "line"))
    bodies = lines.groupBy("col_group").agg(joined_in_order(F.col(ROW_ID), F.col("line"), "\n").alias("body"))
    if not table.n_rows:  # headers without a row
        bodies = few.sparkSession.range(len(groups)).select(F.col("id").cast("int").alias("col_group"), F.lit("").alias("body"))
    names = F.array(*[_lit_array([f.name for f in g]) for g in groups])
    return bodies.select(
        "col_group",
        F.lit(0).cast("long").alias("window"),
        F.lit(None).cast("long").alias("row_start"),
        F.lit(None).cast("long").alias("row_end"),
        F.element_at(names, F.col("col_group") + 1).alias("cols"),
        F.concat(
            F.format_string(f"[Table: {_escaped(name)} | Column Group %d/{len(groups)}: ", F.col("col_group") + 1),
            F.array_join(F.element_at(names, F.col("col_group") + 1), ", "),
            F.lit("]\n"),
            F.col("body"),
        ).alias("text"),
    )


def hybrid_chunks(table: NumberedTable, name: str, window: int = 8, overlap: int = 1, group_size: int = 6) -> DataFrame:
    """Every column group of every row window.

    A row travels once per window, as its cells: the lines, which repeat all names, are written after the shuffle. Windows
    travel in blocks of neighbours, whose rows are most alike.
    """
    cells, short = short_cells(table.fields)
    groups, short = column_groups(table.fields, group_size), column_groups(short, group_size)
    placed = table.rows.selectExpr(ROW_ID, *cells).withColumn("__at", F.explode(windows_of(F.col(ROW_ID), window, overlap)))
    dealt = placed.withColumn("__part", F.floor(F.col("__at") / BLOCK)).repartition("__part")  # no user's columns have these names
    lines = dealt.select("__part", F.col("__at").alias("window"), ROW_ID, F.array(*[row_line(g) for g in short]).alias("lines"))
    gathered = lines.groupBy("__part", "window").agg(F.array_sort(F.collect_list(F.struct(ROW_ID, "lines"))).alias("rows"))
    names = F.array(*[_lit_array([f.name for f in g]) for g in groups])
    split = gathered.select(
        "window", *_bounds(table, window, overlap), "rows", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1))).alias("col_group")
    )
    body = F.array_join(F.transform("rows", lambda r: F.element_at(r["lines"], F.col("col_group") + 1)), "\n")
    header = F.format_string(
        f"[Table: {_escaped(name)} | ColGroup %d × Rows %d–%d]\n", F.col("col_group") + 1, F.col("row_start") + 1, F.col("row_end")
    )
    return split.select(
        "col_group",
        "window",
        "row_start",
        "row_end",
        F.element_at(names, F.col("col_group") + 1).alias("cols"),
        F.concat(header, body).alias("text"),
    )


def pick_strategy(n_rows: int, n_cols: int) -> tuple[str, dict[str, int]]:
    """Chunking for a table of this shape."""
    if n_cols >= fixed.WIDE_TABLE_COLUMNS:
        if n_rows > fixed.WIDE_TABLE_ROWS:
            return "hybrid", {"window": 8, "overlap": 1, "group_size": 6}
        return "column_group", {"row_sample": 25, "group_size": 8}
    if n_rows > fixed.LARGE_TABLE_ROWS:
        return "row_window", {"window": 12, "overlap": 2}
    if n_rows > fixed.MEDIUM_TABLE_ROWS:
        return "row_window", {"window": 10, "overlap": 2}
    return "row_window", {"window": 8, "overlap": 1}


def content_chunks(table: NumberedTable, name: str, strategy: str = "auto") -> DataFrame:
    """Content chunks by a named strategy with its default sizes, or by the table's shape."""
    if strategy == "auto":
        strategy, sizes = pick_strategy(table.n_rows, len(table.columns))
    elif strategy in STRATEGIES:
        sizes = fixed.DEFAULT_PARAMETERS[strategy]
    else:
        raise ValueError(f"unknown strategy {strategy!r}; choose auto or one of {', '.join(STRATEGIES)}")
    build = {"row_window": row_window_chunks, "column_group": column_group_chunks, "hybrid": hybrid_chunks}[strategy]
    return build(table, name, **sizes)


def _escaped(text: str) -> str:
    return text.replace("%", "%%")


def schema_text(profiled: DataFrame, name: str) -> DataFrame:
    """One row ``text``: a line per column with type, distinct and empty counts and samples."""
    line = joined_in_order(F.col("col_ord"), _schema_line(), "\n")
    return profiled.agg(F.concat_ws("\n", F.lit(f"[Schema: {name}]"), line).alias("text"))


def schema_texts(profiled: DataFrame, names: list[str]) -> DataFrame:
    """``(table_ord, text)``: ``schema_text`` of every table, from the profiles of all."""
    head = F.concat(F.lit("[Schema: "), F.get(F.array(*[F.lit(n) for n in names]), F.col("table_ord")), F.lit("]"))
    lines = profiled.groupBy("table_ord").agg(joined_in_order(F.col("col_ord"), _schema_line(), "\n").alias("lines"))
    return lines.select("table_ord", F.concat_ws("\n", head, "lines").alias("text"))


def _schema_line() -> Column:
    return F.concat(
        F.format_string(
            "  %s (%s) | unique=%d | nulls=%d | e.g. ", F.col("column"), F.col("dtype"), F.col("unique_count"), F.col("null_count")
        ),
        F.array_join(F.slice("sample_values", 1, fixed.SAMPLES_SHOWN), ", "),
        F.when(
            F.col("dtype") != "object",
            F.concat(
                F.lit(" | mean="), F.coalesce(float_text("mean"), F.lit("nan")),
                F.lit(", min="), F.coalesce(float_text("min"), F.lit("nan")),
                F.lit(", max="), F.coalesce(float_text("max"), F.lit("nan")),
            ),
        ).otherwise(F.lit("")),
    )


def _stat(column: str) -> Column:
    return F.coalesce(float_text(column), F.lit("nan"))


# Characters that a quoted value spells by their code.
_UNPRINTED = "[\\x00-\\x1f\\x7f-\\xa0\\xad]"


def _quoted_value(value: Column) -> Column:
    """A text in quotes, as Python writes it: in double ones if it holds single ones only; control codes spelled out."""
    spelled = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for sign, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        spelled = F.replace(spelled, F.lit(sign), F.lit(name))
    code = lambda c: F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(c))), 2, "0"))
    by_letter = F.transform(F.split(spelled, ""), lambda c: F.when(c.rlike(_UNPRINTED), code(c)).otherwise(c))
    spelled = F.when(spelled.rlike(_UNPRINTED), F.array_join(by_letter, "")).otherwise(spelled)
    double = value.contains("'") & ~value.contains('"')
    return F.when(double, F.concat(F.lit('"'), spelled, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(spelled, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def stats_text(table: NumberedTable, name: str, approx: bool = False) -> DataFrame:
    """One row ``text``: describe statistics of number columns, then the most frequent values
    of the first text columns. Runs the jobs of ``measure``."""
    return stats_texts(measure({name: table}, approx)).select("text")


def stats_texts(measured: Measures) -> DataFrame:
    """``(table_ord, text)``: ``stats_text`` of every table."""
    spark, lines = measured.top.sparkSession, []
    heads, names = [], []
    for i, (name, table) in enumerate(measured.tables.items()):
        own = [c for c in measured.columns if c[0] == i]
        heads.append((i, f"[Statistical Summary: {name} — {table.n_rows} rows × {len(table.columns)} columns]"))
        names += [(i, c[1], c[2]) for c in own]
        if not any(c[4] for c in own):
            lines.append((i, 1, 0, "No numeric columns detected."))
        if any(c[3] == "object" for c in own):
            lines.append((i, 2, -1, "\nTop categorical values:"))
    line = F.concat(
        F.format_string("  %s: count=%d", F.col("column"), F.col("count")), *[F.concat(F.lit(f", {label}="), _stat(c)) for label, c in _STAT_LABELS]
    )
    described = descriptions(measured).select("table_ord", F.lit(1).alias("part"), "col_ord", line.alias("line"))
    listed = measured.top.groupBy("table_ord", "col_ord").agg(
        joined_in_order(F.col("rank"), F.concat(_quoted_value(F.col("value")), F.lit(":"), F.col("n")), ", ").alias("values")
    )
    listed = listed.join(F.broadcast(spark.createDataFrame(names, "table_ord int, col_ord int, column string")), ["table_ord", "col_ord"])
    listed = listed.select("table_ord", F.lit(2).alias("part"), "col_ord", F.concat(F.lit("  "), "column", F.lit(": "), "values").alias("line"))
    whole = described.unionByName(listed).unionByName(spark.createDataFrame(lines, "table_ord int, part int, col_ord int, line string"))
    joined = joined_in_order(F.struct("part", "col_ord"), F.col("line"), "\n").alias("lines")
    head = F.broadcast(spark.createDataFrame(heads, "table_ord int, head string"))
    return head.join(whole.groupBy("table_ord").agg(joined), "table_ord", "left").select("table_ord", F.concat_ws("\n", "head", "lines").alias("text"))


_STAT_LABELS = [("mean", "mean"), ("std", "std"), ("min", "min"), ("25%", "p25"), ("50%", "p50"), ("75%", "p75"), ("max", "max")]


def overview_text(manifest: DataFrame, description: str) -> DataFrame:
    """One row ``text`` from a manifest ``(table_ord, table, n_rows, n_cols, columns)``."""
    lines = F.concat(
        F.lit("  • "), F.col("table"), F.lit(": "), F.format_number("n_rows", 0), F.lit(" rows × "), F.col("n_cols"),
        F.lit(" columns\n    Columns: "), F.array_join(F.slice("columns", 1, fixed.OVERVIEW_COLUMNS), ", "),
    )
    return manifest.agg(
        F.concat_ws(
            "\n",
            F.lit("=== GLOBAL OVERVIEW ==="),
            F.lit(f"Purpose: {description}"),
            F.concat(F.lit("Number of tables: "), F.count(F.lit(1))),
            joined_in_order(F.col("table_ord"), lines, "\n"),
        ).alias("text")
    )
