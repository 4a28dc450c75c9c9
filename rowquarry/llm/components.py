"""Connected components of a link table by alternating large-star and small-star.

Large-star hangs every larger neighbour of a node on the smallest of its neighbourhood, small-star every smaller
one; both are an aggregation and a join by node, so a node with very many links is never gathered. Each round is
written to the shared folder. The rounds end when the links no longer change: then every node hangs on the smallest
node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowquarry.session import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("low"))
    moved = down.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("a", F.col("low").alias("b")))


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link, from links (a, b) of comparable ids. The component is its
    smallest node. Runs a few jobs a round; no links give no rows."""
    kind = links.schema["a"].dataType
    links = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = _fingerprint(links)
    while seen[0]:
        links = materialise(_small_star(_large_star(links).distinct()).distinct(), "links")
        now = _fingerprint(links)
        if now == seen:
            break
        seen = now
    hung = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return hung.union(roots).select(F.col("node").cast(kind), F.col("component").cast(kind))
