"""Column expressions over text: tokens, question types, cell and row serialisation.

Whatever is repeated per column of a wide table is written as SQL text and parsed in one call:
building it operator by operator from Python costs seconds of driver time on a wide table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.functions import fixed

# Columns that a numbered table has beside its own. All other names are the user's.
TECHNICAL = frozenset({"__row_id", "__part", "__at"})


def quoted(name: str) -> Column:
    """Column by exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def name_sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokenise(text: Column) -> Column:
    """Lower-cased word runs made only of ``[a-z0-9_]``.

    A run holding any other letter or digit (an accent, say) gives no token at all, which is
    what Unicode word boundaries around an ASCII class mean.
    """
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(runs, lambda run: run.rlike("^[a-z0-9_]+$"))


def _ascii_words(text: Column) -> Column:
    """Lower-case, with non-ASCII word characters as ``_`` and other non-ASCII as spaces,
    so ASCII word boundaries fall where Unicode ones would."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\x00-\x7F\p{L}\p{N}]", " ")
    return F.regexp_replace(spaced, r"[^\x00-\x7F]", "_")


def classify(text: Column) -> Column:
    """'analytical', else 'lookup', else 'conversational'; the first list that matches wins."""
    words = _ascii_words(text)

    def any_of(patterns: list[str]) -> Column:
        return words.rlike("|".join(f"(?:{p})" for p in patterns))

    return (
        F.when(any_of(fixed.ANALYTICAL_PATTERNS), "analytical")
        .when(any_of(fixed.LOOKUP_PATTERNS), "lookup")
        .otherwise("conversational")
    )


def context_size(question_type: Column) -> Column:
    """How many chunks a question of this type gets."""
    return F.when(question_type == "analytical", fixed.ANALYTICAL_TOP_K).otherwise(fixed.RETRIEVE_TOP_K)


def float_sql(x: str) -> str:
    """A double as Python prints it: ``900.0``, ``12345678.91``, ``1e-05``, ``nan``.

    In the usual range the JVM prints the same. The rest is laid out again in a lambda over a
    one-item array, which keeps the generated code for each column small.
    """
    return (
        f"CASE WHEN {x} IS NULL THEN NULL "
        f"WHEN (abs({x}) >= 1e-3D AND abs({x}) < 1e7D) OR {x} = 0D THEN string({x}) "
        f"ELSE get(transform(array({x}), v -> {_FAR_FLOAT}), 0) END"
    )


# Very large, very small and special values. The JVM gives the right digits but with an exponent;
# an exact decimal lays them out plainly where Python would.
_FAR_FLOAT = """CASE
  WHEN isnan(v) THEN 'nan'
  WHEN abs(v) = double('inf') THEN if(v > 0, 'inf', '-inf')
  WHEN abs(v) >= 1e-4D AND abs(v) < 1e16D THEN
    regexp_replace(regexp_replace(string(cast(string(v) AS decimal(38, 20))), '0+$', ''), '[.]$', '.0')
  ELSE concat(
    regexp_replace(substring_index(string(v), 'E', 1), '[.]0$', ''),
    if(int(substring_index(string(v), 'E', -1)) < 0, 'e-', 'e+'),
    lpad(string(abs(int(substring_index(string(v), 'E', -1)))), 2, '0')) END"""


def cell_sql(x: str, dtype: T.DataType) -> str:
    """Any cell as text; null becomes the empty string."""
    if isinstance(dtype, T.FloatType):
        return cell_sql(f"double({x})", T.DoubleType())
    if isinstance(dtype, T.DoubleType):
        text = float_sql(x)
    elif isinstance(dtype, T.BooleanType):
        text = f"CASE WHEN {x} THEN 'True' WHEN NOT {x} THEN 'False' END"
    elif isinstance(dtype, T.ArrayType):
        quote = "'\\''" if isinstance(dtype.elementType, T.StringType) else "''"
        item = cell_sql("item", dtype.elementType)
        text = f"concat('[', array_join(transform({x}, item -> concat({quote}, {item}, {quote})), ', '), ']')"
    elif isinstance(dtype, (T.StructType, T.MapType)):
        text = f"to_json({x})"
    else:
        text = f"string({x})"
    return f"coalesce({text}, '')"


def float_text(name: str) -> Column:
    return F.expr(float_sql(name_sql(name)))


def cell_text(field: T.StructField) -> Column:
    return F.expr(cell_sql(name_sql(field.name), field.dataType))


def shorten(text: Column, limit: int = fixed.MAX_VALUE_LENGTH) -> Column:
    """Text over ``limit`` characters keeps its first ``limit`` and an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def row_line(fields: list[T.StructField], limit: int = fixed.MAX_VALUE_LENGTH) -> Column:
    """One row as ``column: value | column: value``, long values shortened."""
    parts = []
    for f in fields:
        text = cell_sql(name_sql(f.name), f.dataType)
        if isinstance(f.dataType, (T.StringType, T.ArrayType, T.StructType, T.MapType)):
            text = f"if(length({text}) > {limit}, concat(substring({text}, 1, {limit}), '…'), {text})"
        parts.append(f"concat({text_sql(f.name + ': ')}, {text})")
    return F.expr(f"concat_ws(' | ', {', '.join(parts)})")


def short_cells(fields: list[T.StructField], limit: int = fixed.MAX_VALUE_LENGTH) -> tuple[list[str], list[T.StructField]]:
    """SQL and fields of columns of which ``row_line`` makes the same line, and that are not longer than it needs: long texts
    are cut one character after the limit, lists and records written as text."""
    cells, short = [], []
    for f in fields:
        name = name_sql(f.name)
        if isinstance(f.dataType, (T.StringType, T.ArrayType, T.StructType, T.MapType)):
            cells.append(f"substring({cell_sql(name, f.dataType)}, 1, {limit + 1}) AS {name}")
            short.append(T.StructField(f.name, T.StringType()))
        else:
            cells.append(name)
            short.append(f)
    return cells, short


def joined_in_order(order: Column, text: Column, separator: str) -> Column:
    """Aggregate: the group's texts joined in ``order``. For groups of bounded size only."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("s"))))
    return F.array_join(F.transform(pairs, lambda p: p["s"]), separator)


def is_technical(name: str) -> bool:
    return name in TECHNICAL
