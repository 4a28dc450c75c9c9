"""A bounded filter for the keys of a join: rows of a large side that surely find no partner are dropped where they lie."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowquarry.session import materialise

BITS_PER_KEY = 10
HASHES = 4
MAX_BITS = 1 << 27  # 16 MB: with more keys the filter lets more through, and never too little


def _places(key: Column, bits: int) -> list[Column]:
    h = F.xxhash64(F.lit("sieve"), key)
    low, high = h.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
    return [(low + high * F.lit(i)) % F.lit(bits) for i in range(HASHES)]


def sieve(keys: DataFrame, name: str, n_keys: int, max_bits: int = MAX_BITS) -> Column:
    """A predicate over a column ``name``: true for every key in the column ``name`` of ``keys``, and for few others.

    Runs one job that stores the filter, one row of at most ``max_bits`` bits, which every task then gets as a constant.
    """
    words = max(1, min(max_bits, n_keys * BITS_PER_KEY) // 64)
    bits = 64 * words
    places = keys.select(F.explode(F.array(*_places(F.col(name), bits))).alias("p"))
    own = places.selectExpr("p div 64 AS w", "shiftleft(1L, int(p % 64)) AS b").groupBy("w").agg(F.expr("bit_or(b) AS b"))
    blank = keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    merged = own.union(blank).groupBy("w").agg(F.expr("bit_or(b) AS b"))
    row = merged.agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("s")).select(F.transform("s", lambda s: s["b"]).alias("words"))
    table = materialise(row, "sieve").scalar()
    tests = [F.getbit(F.get(table, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in _places(F.col(name), bits)]
    return reduce(lambda a, b: a & b, tests)
