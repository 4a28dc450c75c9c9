"""Cleaning: column names, duplicate rows, nulls, and text that is really numbers."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.functions import fixed
from rowquarry.functions.text import is_technical, name_sql, quoted, text_sql
from rowquarry.operators.rows import NumberedTable, number_rows
from rowquarry.session import passing

_UNNAMED = re.compile("Unnamed")
_ORDER = "__order"  # no cleaned name begins like this


def normal_name(name: str) -> str:
    """ASCII, lower case, one ``_`` for each run of other characters; ``col`` if nothing is left."""
    ascii_name = unicodedata.normalize("NFKD", str(name).strip()).encode("ascii", "ignore").decode()
    return re.sub(r"\W+", "_", ascii_name).strip("_").lower() or "col"


def unique_names(names: list[str]) -> list[str]:
    """Repeats get ``_1``, ``_2``…, counting on past names already taken."""
    taken: set[str] = set()
    repeats: dict[str, int] = {}
    result = []
    for name in names:
        candidate = name
        while candidate in taken:
            repeats[name] = repeats.get(name, 0) + 1
            candidate = f"{name}_{repeats[name]}"
        taken.add(candidate)
        result.append(candidate)
    return result


def tidy_columns(df: DataFrame, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Drop columns without a name; give the others normal, unique names. ``hidden`` columns stay as they are, at the end.

    Columns are taken by place, so names that differ only in case are told apart.
    """
    places = {f"c{i}": c for i, c in enumerate(df.columns)}
    plain = [p for p, c in places.items() if c not in hidden and not _UNNAMED.match(c)]
    renamed = dict(zip(plain, unique_names([normal_name(places[p]) for p in plain])))
    renamed |= {p: c for p, c in places.items() if c in hidden}
    return df.toDF(*places).selectExpr(*[f"{p} AS {name_sql(c)}" for p, c in renamed.items()])


def plain_types(df: DataFrame) -> DataFrame:
    """Whole numbers as long, floating numbers as double, dates and times as text; decimals stay exact."""

    def plain(f: T.StructField) -> str:
        name = name_sql(f.name)
        if is_technical(f.name):
            return name
        if isinstance(f.dataType, T.IntegralType):
            return f"bigint({name}) AS {name}"
        if isinstance(f.dataType, T.FloatType):
            return f"double({name}) AS {name}"
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
            return f"string({name}) AS {name}"
        return name

    return df.selectExpr(*[plain(f) for f in df.schema.fields])


def distinct_rows(df: DataFrame, order: str | None = None) -> DataFrame:
    """Drop full duplicates. The column ``order`` is not part of a row: the copies' smallest value is kept.

    Partial aggregation merges copies before the shuffle, so a row repeated a billion times
    sends one record per task.
    """
    columns = [name_sql(c) for c in df.columns if c != order]
    if order is None:
        return df.selectExpr(*columns).distinct()
    return df.groupBy(*columns).agg(F.min(order).alias(order))


def fill_nulls(df: DataFrame) -> DataFrame:
    """Null text becomes '', null numbers 0, null booleans false, null lists empty."""

    def filled(f: T.StructField) -> str:
        name, kind = name_sql(f.name), f.dataType.simpleString()
        if is_technical(f.name):
            return name
        if isinstance(f.dataType, T.StringType):
            return f"coalesce({name}, '') AS {name}"
        if isinstance(f.dataType, T.BooleanType):
            return f"coalesce({name}, false) AS {name}"
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return f"nanvl(coalesce({name}, 0), cast(0 AS {kind})) AS {name}"
        if isinstance(f.dataType, T.NumericType):
            return f"coalesce({name}, cast(0 AS {kind})) AS {name}"
        if isinstance(f.dataType, T.ArrayType):
            return f"coalesce({name}, cast(array() AS {kind})) AS {name}"
        return name

    return df.selectExpr(*[filled(f) for f in df.schema.fields])


def _digits(column: Column) -> Column:
    return F.btrim(F.replace(column, F.lit(","), F.lit("")), F.lit(" \t\r\n\f\v"))


def parsed_number(column: Column) -> Column:
    """Text as double, thousands commas removed; null unless it is written as a number."""
    text = _digits(column)
    return F.when(text.rlike(fixed.NUMBER_PATTERN), text.try_cast("double"))


def _parsed_integer(column: Column) -> Column:
    text = _digits(column)
    return F.when(text.rlike(fixed.INTEGER_PATTERN), text.try_cast("long"))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and not is_technical(f.name)]


def parse_rates(df: DataFrame) -> DataFrame:
    """``(column, rate, whole)``: per text column the share of rows that parse and that are
    whole numbers. One pass; each task sends one record per column."""
    cells = ", ".join(f"struct({text_sql(c)} AS column, {name_sql(c)} AS value)" for c in text_columns(df))
    value = F.col("value")
    return (
        df.selectExpr(f"inline(array({cells}))")
        .groupBy("column")
        .agg(
            F.avg(parsed_number(value).isNotNull().cast("int")).alias("rate"),
            F.avg(_parsed_integer(value).isNotNull().cast("int")).alias("whole"),
        )
    )


def number_types(df: DataFrame, threshold: float = fixed.NUMERIC_SHARE) -> dict[str, str]:
    """Which text columns become numbers: name → 'bigint' or 'double'. Runs one job.

    A column converts when strictly more than ``threshold`` of its rows parse; it is whole
    only if every row is.
    """
    if not text_columns(df):
        return {}
    found = parse_rates(df).filter(F.col("rate") > threshold).collect()  # at most one row per column
    return {r["column"]: "bigint" if r["whole"] == 1.0 else "double" for r in found}


def coerce_numbers(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Apply ``number_types``; cells that do not parse become 0."""

    kept = {c: quoted(c) for c in df.columns if c in types}
    changed = {
        c: F.coalesce(_parsed_integer(column), F.lit(0).cast("long"))
        if types[c] == "bigint"
        else F.coalesce(parsed_number(column), F.lit(0.0))
        for c, column in kept.items()
    }
    return df.withColumns(changed) if changed else df


def clean(df: DataFrame) -> DataFrame:
    """All cleaning steps, order left open. Runs one job to decide number columns."""
    filled = fill_nulls(distinct_rows(plain_types(tidy_columns(df))))
    return coerce_numbers(filled, number_types(filled))


def clean_numbered(df: DataFrame, order_by: list[str | Column], hidden: tuple[str, ...] | None = None) -> NumberedTable:
    """Clean, keeping first copies in order, and number the rows. Runs jobs: a write of the distinct rows, which are deleted
    again, the numbering write and one pass over it to decide number columns.

    ``hidden`` columns serve the order only and are not part of the rows; by default those of ``order_by`` that bear a
    numbered table's own names (a table that is cleaned again by its row numbers, say). When the order is by columns of the table,
    copies agree on it and a plain distinct does; otherwise the smallest order value of the copies is carried along.
    """
    if hidden is None:
        hidden = tuple(c for c in order_by if isinstance(c, str) and is_technical(c))
    plain = [c for c in df.columns if c not in hidden and not _UNNAMED.match(c)]
    if all(isinstance(c, str) and c in plain for c in order_by):
        shown = df.select(*[quoted(c) for c in df.columns if c not in hidden]) if hidden else df
        tidy = plain_types(tidy_columns(shown))
        with passing(distinct_rows(tidy), "distinct") as distinct:
            numbered = number_rows(distinct, [tidy.columns[plain.index(c)] for c in order_by])
    else:
        order = F.struct(*[(quoted(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order_by)])
        placed = df.select(*[quoted(c) for c in df.columns if c not in hidden], order.alias(_ORDER)) if hidden else df.select("*", order.alias(_ORDER))
        tidy = plain_types(tidy_columns(placed, (_ORDER,)))
        with passing(distinct_rows(tidy, _ORDER), "distinct") as distinct:
            numbered = number_rows(distinct, [_ORDER], hidden=(_ORDER,))
    filled = fill_nulls(numbered.rows)
    return numbered.with_rows(coerce_numbers(filled, number_types(filled)))


def numbered_as_is(df: DataFrame, order_by: list[str | Column]) -> NumberedTable:
    """Number a table known to hold no duplicates and no dirty text: plain types, nulls filled."""
    numbered = number_rows(plain_types(df), order_by)
    return numbered.with_rows(fill_nulls(numbered.rows))
