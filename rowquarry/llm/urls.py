"""URL filters: a few host and path rules first, then exact membership in a long block list by a Bloom filter cascade.

A key is a host or a host with its path. The universe is every key of the judged table. Level 1 is a Bloom filter of the
listed keys; level 2 holds the keys of the universe that level 1 takes wrongly; level 3 the listed keys that level 2 takes
wrongly, and so on until a level takes nothing wrongly. So a key of the universe is judged exactly by the first level that
does not hold it, without a join against the list. Each level hashes anew, so levels shrink by their false rate.

Everything is built from DataFrame functions. A filter is an array of 64-bit words that each task gets as a constant. The
list is cut by hash into segments whose first level stays under ``MAX_BITS``; with more than one, the table is judged one
segment after the other, so that a task never holds more than one segment's levels, however long the list is.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is in no list (allow).
Repeated rows are judged alike, each on its own row; null and empty listed keys are ignored; an empty list blocks nothing;
an empty table gives no rows. Only the columns named by ``keep`` are carried; one that bears a result's name is replaced
by the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowquarry.functions.text import quoted
from rowquarry.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FIRST = (12, 8)  # bits a key and hash functions of the first level: 0.3 % taken wrongly
LATER = (5, 3)  # and of all others: 9 %
MAX_BITS = 1 << 27  # of one filter: 16 MB


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        own = (host == self.host) | host.endswith("." + self.host)
        return own & path.startswith(self.path)


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


@dataclass(frozen=True)
class Level:
    """One filter: ``words`` is a table of one row with the array ``words``."""

    words: DataFrame
    bits: int
    hashes: int


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; empty without ``://``."""
    part = [F.coalesce(F.regexp_extract(url, URL, k), F.lit("")) for k in (1, 2)]
    return F.translate(part[0], UPPER, LOWER), part[1]


def _segment(key: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("segment"), key), F.lit(segments))


def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Bit places of a key in a filter: double hashing of one 64-bit hash, seeded by the level."""
    h = F.xxhash64(F.lit(level), key)
    low, high = h.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
    return [(low + high * F.lit(i)) % F.lit(bits) for i in range(hashes)]


def _filter(keys: DataFrame, n: int, number: int) -> Level:
    """A filter of the column ``key`` of ``n`` keys. Bits are merged word by word before the words meet in one row."""
    per_key, hashes = FIRST if number == 1 else LATER
    n_words = max(1, -(-n * per_key // 64))
    bits = 64 * n_words
    places = keys.select(F.explode(F.array(*_places(F.col("key"), number, bits, hashes))).alias("p"))
    words = places.selectExpr("p div 64 AS w", "shiftleft(1L, int(p % 64)) AS b").groupBy("w").agg(F.expr("bit_or(b) AS b"))
    blank = keys.sparkSession.range(n_words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    merged = words.union(blank).groupBy("w").agg(F.expr("bit_or(b) AS b"))
    row = merged.agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("s")).select(F.transform("s", lambda s: s["b"]).alias("words"))
    return Level(materialise(row, "url-level"), bits, hashes)


def _holds(level: Level, number: int, key: Column) -> Column:
    words = level.words.scalar()
    tests = [
        F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
        for p in _places(key, number, level.bits, level.hashes)
    ]
    return reduce(lambda a, b: a & b, tests)


def cascade(universe: DataFrame, max_levels: int = 64) -> list[Level]:
    """Levels that tell the listed keys of ``universe(key, listed)`` from all others, exactly. The keys are distinct.

    Runs a few jobs a level; each level's keys are those that the one before takes wrongly, stored in the shared folder.
    """
    inside, outside = universe.filter("listed").select("key"), universe.filter("NOT listed").select("key")
    levels: list[Level] = []
    while n := inside.count():
        if len(levels) == max_levels:
            raise RuntimeError("two keys share all their hashes")
        level = _filter(inside, n, len(levels) + 1)
        levels.append(level)
        wrong = materialise(outside.filter(_holds(level, len(levels), F.col("key"))), "url-wrong")
        inside, outside = wrong, inside
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed. The last level takes nothing wrongly."""
    verdict = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels), 0, -1):
        verdict = F.when(_holds(levels[number - 1], number, key), verdict).otherwise(F.lit(number % 2 == 0))
    return verdict


def _keys(host: Column, path: Column) -> list[Column]:
    return [host, F.concat(host, path)]


def _universe(placed: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, listed) of every key of the table, once, and of every listed key, once."""
    own = placed.select(F.explode(F.array(*_keys(F.col("host"), F.col("path")))).alias("key"), F.lit(False).alias("listed"))
    theirs = listed.select(F.col("key").cast("string").alias("key"), F.lit(True).alias("listed"))
    return own.union(theirs).filter("key <> ''").groupBy("key").agg(F.bool_or("listed").alias("listed"))


def judge(
    pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("page_id",), url: str = "url",
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """The columns ``keep`` and host, path, rule, verdict of every row of ``pages``.

    The longest rule that fits decides (of two as long, the one with the longer host); without one a page is blocked if
    ``listed(key)`` has its host, or its host and path. Runs the jobs that build the levels.
    """
    host, path = host_and_path(F.col(url))
    kept = [quoted(c) for c in keep if c not in ("host", "path", "rule", "verdict")]
    placed = pages.select(*kept, host.alias("host"), path.alias("path"))
    universe = materialise(_universe(placed, listed), "url-keys")
    segments = max(1, -(-universe.filter("listed").count() * FIRST[0] // max_bits))
    hit, judged = F.lit(False), placed
    for s in range(segments):
        levels = cascade(universe.filter(_segment(F.col("key"), segments) == s))
        for key in _keys(F.col("host"), F.col("path")):
            hit = hit | ((key != "") & (_segment(key, segments) == s) & member(levels, key))
        if segments > 1:
            judged = materialise(judged.withColumn("__hit", hit), "url-judged")
            hit = F.col("__hit")
    rule, verdict = F.lit(None).cast("string"), F.when(hit, "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return judged.select(*kept, "host", "path", rule.alias("rule"), verdict.alias("verdict"))
