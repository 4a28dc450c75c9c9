"""From named tables to one chunk table, and its manifest and summaries."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowquarry.functions import fixed
from rowquarry.functions.text import is_technical, joined_in_order
from rowquarry.operators.chunks import (
    column_groups, content_chunks, overview_text, pick_strategy, schema_texts, stats_texts, window_count,
)
from rowquarry.operators.clean import clean_numbered
from rowquarry.operators.counted import measure, profiles
from rowquarry.operators.profile import dtype_name
from rowquarry.operators.rows import NumberedTable
from rowquarry.session import side_by_side

CHUNK_COLUMNS = ["chunk_id", "table", "chunk_type", "col_group", "row_start", "row_end", "cols", "text"]


def manifest(tables: dict[str, DataFrame | NumberedTable]) -> DataFrame:
    """``(table_ord, table, n_rows, n_cols, columns)``, one row per table in the given order."""
    rows = []
    for i, (name, table) in enumerate(tables.items()):
        frame = table.rows if isinstance(table, NumberedTable) else table
        names = [c for c in frame.columns if not is_technical(c)]
        rows.append(
            frame.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(i).alias("table_ord"),
                F.lit(name).alias("table"),
                "n_rows",
                F.lit(len(names)).alias("n_cols"),
                F.array(*[F.lit(c) for c in names]).cast("array<string>").alias("columns"),
            )
        )
    return reduce(DataFrame.unionByName, rows)


def number_tables(tables: dict[str, DataFrame], order_by: dict[str, list[str | Column]]) -> dict[str, NumberedTable]:
    """Clean and number every table in its given total order. Runs jobs per table."""
    numbered = side_by_side([partial(clean_numbered, df, order_by[name]) for name, df in tables.items()])
    return dict(zip(tables, numbered))


def _content_shape(table: NumberedTable, strategy: str) -> tuple[str, int, int]:
    """(strategy, column groups, windows) the content of this table is cut into."""
    sizes = fixed.DEFAULT_PARAMETERS.get(strategy)
    if sizes is None:
        strategy, sizes = pick_strategy(table.n_rows, len(table.columns))
    groups = len(column_groups(table.columns, sizes["group_size"])) if "group_size" in sizes else 1
    windows = window_count(table.n_rows, sizes["window"], sizes["overlap"]) if "window" in sizes else 1
    return strategy, groups, windows


def build_chunks(tables: dict[str, NumberedTable], description: str, strategy: str = "auto", approx: bool = False) -> DataFrame:
    """All chunks: the overview, then per table its schema, statistics and content.

    Runs the few jobs of ``measure`` for all tables together; ``approx`` takes sketches instead of exact counts. ``chunk_id``
    is the place in that order and is computed from the row counts, so no chunk is shuffled or sorted to get it.
    """
    parts = [_single(overview_text(manifest(tables), description), F.lit(0), F.lit("_global"), "overview")]
    content, firsts, next_id = [], [], 1
    for name, table in tables.items():
        chosen, groups, windows = _content_shape(table, strategy)
        firsts.append(next_id)
        group = F.coalesce(F.col("col_group"), F.lit(0)).cast("long")
        content.append(
            content_chunks(table, name, strategy).select(
                (F.lit(next_id + 2) + group * F.lit(windows) + F.col("window")).cast("long").alias("chunk_id"),
                F.lit(name).alias("table"),
                F.lit(chosen).alias("chunk_type"),
                "col_group", "row_start", "row_end", "cols", "text",
            )
        )
        next_id += 2 + groups * windows
    if tables:
        measured = measure(tables, approx)
        of = [F.get(F.array(*[F.lit(x) for x in values]), F.col("table_ord")) for values in (firsts, list(tables))]
        parts.append(_single(schema_texts(profiles(measured), list(tables)), of[0], of[1], "schema"))
        parts.append(_single(stats_texts(measured), of[0] + 1, of[1], "stats"))
    return reduce(DataFrame.unionByName, [*parts, *content]).select(*CHUNK_COLUMNS)


def count_chunks(tables: dict[str, NumberedTable], strategy: str = "auto") -> int:
    """How many chunks ``build_chunks`` makes of these tables, from their shapes alone."""
    return 1 + sum(2 + groups * windows for _, groups, windows in (_content_shape(t, strategy) for t in tables.values()))


def _single(text: DataFrame, chunk_id: Column, table: Column, chunk_type: str) -> DataFrame:
    return text.select(
        chunk_id.cast("long").alias("chunk_id"),
        table.alias("table"),
        F.lit(chunk_type).alias("chunk_type"),
        F.lit(None).cast("int").alias("col_group"),
        F.lit(None).cast("long").alias("row_start"),
        F.lit(None).cast("long").alias("row_end"),
        F.lit(None).cast("array<string>").alias("cols"),
        "text",
    )


def schema_summary(tables: dict[str, DataFrame | NumberedTable]) -> DataFrame:
    """One row ``summary``: ``Table 'n' [rows rows]: column (type), …`` per table."""
    lines = []
    for i, (name, table) in enumerate(tables.items()):
        frame = table.rows if isinstance(table, NumberedTable) else table
        fields = [f for f in frame.schema.fields if not is_technical(f.name)]
        listed = ", ".join(f"{f.name} ({dtype_name(f.dataType)})" for f in fields)
        counted = frame.agg(F.count(F.lit(1)).alias("n"))
        lines.append(
            counted.select(
                F.lit(i).alias("table_ord"),
                F.concat(F.lit(f"Table '{name}' ["), F.col("n"), F.lit(f" rows]: {listed}")).alias("line"),
            )
        )
    return reduce(DataFrame.unionByName, lines).agg(joined_in_order(F.col("table_ord"), F.col("line"), "\n").alias("summary"))


def corpus_totals(tables: dict[str, NumberedTable], chunks: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """One row ``(tables, total_rows, total_chunks)``. Without ``chunks`` their number follows from the tables' shapes."""
    totals = manifest(tables).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("table_ord", "table"))), lambda t: t["table"]).alias("tables"),
        F.sum("n_rows").alias("total_rows"),
    )
    if chunks is None:
        return totals.withColumn("total_chunks", F.lit(count_chunks(tables, strategy)).cast("long"))
    return totals.withColumn("total_chunks", chunks.agg(F.count(F.lit(1))).scalar())
