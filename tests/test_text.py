import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.functions import fixed
from rowquarry.functions.text import classify, float_text, row_line, shorten, tokenise

TEXTS = [
    "", "   ", "Hello, World_1!", "Étion dans été abc", "naïve cafe x2 ½ ²", "a_b-c.d  e", "ÀB ab", "日本 go 日go", "tab\tnew\nline",
    "What is the AVERAGE?", "vs. others", "vs others", "top 10 items", "top items", "recount", "démaximum", "maximum—x", "who is it",
    "lookup", "look up x", "columns", "column", None,
]


def python_tokens(text):
    return re.findall(r"\b[a-z0-9_]+\b", (text or "").lower())


def python_type(text):
    lowered = (text or "").lower()
    if any(re.search(p, lowered) for p in fixed.ANALYTICAL_PATTERNS):
        return "analytical"
    return "lookup" if any(re.search(p, lowered) for p in fixed.LOOKUP_PATTERNS) else "conversational"


def test_tokens_and_types_agree_with_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for row in df.select("t", tokenise(F.col("t")).alias("tokens"), classify(F.col("t")).alias("kind")).collect():
        assert row["tokens"] == python_tokens(row["t"]), row["t"]
        assert row["kind"] == python_type(row["t"]), row["t"]


def test_floats_print_as_in_python(spark):
    rng = random.Random(7)
    values = [0.0, -0.0, 1.0, -2.5, 900.0, 1e7, 12345678.91, 1e10, 1e15, 1e16, 1.5e17, -3e20, 1e-3, 1e-4, 0.00012345, 1e-5, 2.5e-7]
    values += [float("inf"), float("-inf"), float("nan"), 123456789.123456, 99999999.99]
    values += [round(rng.uniform(-1e9, 1e9), 2) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for row in df.select("v", float_text("v").alias("s")).collect():
        assert row["s"] == str(row["v"])


@pytest.mark.parametrize("length,kept", [(199, 199), (200, 200), (201, 201)])
def test_long_values_are_cut(spark, length, kept):
    out = spark.range(1).select(shorten(F.lit("é" * length)).alias("s")).first()["s"]
    assert len(out) == kept
    assert out.endswith("…") == (length > 200)


def test_row_line(spark):
    df = spark.createDataFrame([(1, 2.0, "x", None, ["a", "b"], True)], "a long, b double, c string, d string, e array<string>, f boolean")
    line = df.select(row_line(df.schema.fields).alias("l")).first()["l"]
    assert line == "a: 1 | b: 2.0 | c: x | d:  | e: ['a', 'b'] | f: True"
    assert isinstance(df.schema.fields[0].dataType, T.LongType)
