"""Contiguous row numbers for tables of any size."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowquarry.functions.text import is_technical, name_sql, quoted
from rowquarry.session import materialise_compact as materialise

ROW_ID = "__row_id"
_PART = "__part"
_AT = "__at"


@dataclass(frozen=True)
class NumberedTable:
    """A table in a fixed order: ``rows`` has the columns plus 0-based ``__row_id``."""

    rows: DataFrame
    n_rows: int
    starts: tuple[tuple[int, int], ...]  # (partition, its first row number)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if not is_technical(c)]

    @property
    def fields(self):
        return [f for f in self.rows.schema.fields if not is_technical(f.name)]

    def with_rows(self, rows: DataFrame) -> NumberedTable:
        return NumberedTable(rows, self.n_rows, self.starts)

    def at(self, row_ids: list[int]) -> DataFrame:
        """The given few rows. The predicate also names their partitions and places, which
        reach the parquet scan and skip every other row group."""
        wanted = sorted(i for i in set(row_ids) if 0 <= i < self.n_rows)
        if not wanted:
            return self.rows.filter(F.lit(False))
        places = []
        for row_id in wanted:
            part, start = max((s for s in self.starts if s[1] <= row_id), key=lambda s: (s[1], s[0]))
            places.append((part, row_id - start))
        return self.rows.filter(
            F.col(_PART).isin(sorted({p for p, _ in places}))
            & F.col(_AT).isin(sorted({a for _, a in places}))
            & F.col(ROW_ID).isin(wanted)
        )


def number_rows(df: DataFrame, order_by: list[str | Column], hidden: tuple[str, ...] = ()) -> NumberedTable:
    """Number rows 0, 1, 2… in a total order. Runs jobs: a range shuffle written to shared
    storage, and a count per partition. ``hidden`` columns serve the order only.

    Range partitioning on the whole key splits even one hot leading value; a row's number is
    its place in its partition plus the rows in earlier partitions. No task sees more than
    its own partition, and the driver only the partition counts.
    """
    order = [quoted(c) if isinstance(c, str) else c for c in order_by]
    keys = [f"__key_{i}" for i in range(len(order))]
    if taken := [c for c in df.columns if is_technical(c)]:
        raise ValueError(f"rename the columns {taken}: a numbered table has its own of these names")
    plain = [name_sql(c) for c in df.columns if c not in hidden]
    if all(isinstance(c, str) and c not in hidden for c in order_by):
        keyed, keys = df.selectExpr(*plain), []  # a row travels once, without copies of its key
    elif all(isinstance(c, str) for c in order_by):
        keyed = df.selectExpr(*plain, *[f"{name_sql(c)} AS {k}" for c, k in zip(order_by, keys)])
    else:
        keyed = df.select(*[F.expr(c) for c in plain], *[o.alias(k) for o, k in zip(order, keys)])
    by = keys or order
    placed = (
        keyed.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn(_PART, F.spark_partition_id())
        .withColumn(_AT, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(*keys)
    )
    written = materialise(placed, "rows")
    counts = {r[_PART]: r["n"] for r in written.groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    if not starts:
        return NumberedTable(written.withColumn(ROW_ID, F.lit(0).cast("long")), 0, ())
    first = dict(starts)
    # One literal per partition, indexed in place: no join.
    offsets = F.lit(np.array([first.get(p, 0) for p in range(starts[-1][0] + 1)], dtype=np.int64))
    rows = written.withColumn(ROW_ID, F.get(offsets, F.col(_PART)) + F.col(_AT))
    return NumberedTable(rows, total, tuple(starts))


def even_positions(n_rows: int, sample: int) -> list[int]:
    """``min(sample, n_rows)`` row numbers spread evenly from the first to the last row."""
    k = min(sample, n_rows)
    if k <= 1:
        return [0] * k
    spacing = (n_rows - 1) / (k - 1)
    return [int(i * spacing) for i in range(k - 1)] + [n_rows - 1]
