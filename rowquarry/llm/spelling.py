"""Spelling variants: words one insertion, deletion or replacement apart, found by PartEnum signatures.

A word's letters are a multiset, a binary vector over (letter, occurrence). One insertion or deletion changes it in one
place, one replacement in two, so near words have vectors of Hamming distance at most two. PartEnum deals the letters
over partitions and enumerates the ways to leave ``distance`` partitions out: two vectors that near agree exactly on one
of the projections that are left, and an equi-join of these signatures finds every near pair. Words of one length are
joined at distance 2, words of lengths that differ by one at distance 1.

A signature also bears the lengths and one half of the word, in letters and order: one change leaves the first or the
second half as it was. That keeps anagrams apart, loses no pair and holds the groups of equal signatures to words that
really look alike. Candidates are verified by edit distance inside the join, so that none is written.

Defined results: null and empty texts hold no words; a null id counts as an empty one; repeated rows count again; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowquarry.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "[A-Za-zÀ-ÿ]{{{0},}}"  # the maximal runs of at least so many
SHORTEST = 6
LEAST = 5  # occurrences
TIMES = 5  # a form is at least so many times as frequent
DAMAGED = 199  # one run in so many loses a letter
PARTITIONS = {1: 3, 2: 4}  # by distance: 3 and 6 signatures a half


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of the words of ``shortest`` letters or more found ``least`` times or more."""
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(RUNS.format(shortest)), F.lit(0))).alias("run"),
    )
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = runs.select("id", low.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    cut = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring(F.col("run"), F.lit(1), cut), F.substring(F.col("run"), cut + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGED == 0, damaged).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def deal_letters(vocabulary: DataFrame, partitions: int) -> list[str]:
    """The letters of a vocabulary in partitions of about as many letters: the most frequent first, to the emptiest.
    Runs one aggregate job; there are no more letters than the word pattern has."""
    found = vocabulary.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()
    dealt, load = [""] * partitions, [0] * partitions
    for row in sorted(found, key=lambda r: (-r["n"], r["c"])):
        k = load.index(min(load))
        dealt[k] += row["c"]
        load[k] += row["n"]
    return dealt


def _projections(letters: Column, partitions: list[str], distance: int) -> list[Column]:
    """A word's sorted letters without those of ``distance`` partitions, for every choice of these."""
    left_out = [["".join(partitions[k] for k in gone), gone] for gone in combinations(range(len(partitions)), distance)]
    return [F.concat_ws("|", F.lit(str(gone)), F.regexp_replace(letters, f"[{out}]+", "") if out else letters) for out, gone in left_out]


def signatures(vocabulary: DataFrame, partitions: list[str], distance: int, shared: Column) -> DataFrame:
    """(key, word, n): the signatures of every word of ``shared`` letters or one more, each with either half."""
    letters = F.array_join(F.array_sort(F.split("word", "")), "")
    half = F.floor(shared / 2).cast("int")
    halves = [
        F.concat(F.lit("<"), F.substring(F.col("word"), F.lit(1), half)),
        F.concat(F.lit(">"), F.substring(F.col("word"), F.length("word") - (shared - half) + 1, F.length("word"))),
    ]
    keys = F.explode(F.array(*[F.xxhash64(shared, h, p) for p in _projections(F.col("letters"), partitions, distance) for h in halves]))
    return vocabulary.withColumn("letters", letters).select(keys.alias("key"), "word", "n")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of every two near words, either way round, once. Reads a stored vocabulary.

    Spark sizes signatures by the stored words they are made of, as if a word had one: left to itself it sends all of them
    through the driver while the words are few enough. Sorted joins are asked for."""
    length = F.length("word")

    def side(found: DataFrame, tag: str) -> DataFrame:
        return found.select("key", F.col("word").alias(f"{tag}"), F.col("n").alias(f"{tag}_n"))

    one_off = F.levenshtein("a", "b", 1) == 1
    two = deal_letters(vocabulary, PARTITIONS[2])
    same = signatures(vocabulary, two, 2, length)
    replaced = side(same, "a").join(side(same, "b").hint("merge"), "key").filter((F.col("a") < F.col("b")) & one_off)
    one = deal_letters(vocabulary, PARTITIONS[1])
    shorter, longer = signatures(vocabulary, one, 1, length), signatures(vocabulary, one, 1, length - 1)
    inserted = side(shorter, "a").join(side(longer, "b").hint("merge"), "key").filter((F.length("a") + 1 == F.length("b")) & one_off)
    pairs = replaced.union(inserted).drop("key").distinct()
    return pairs.select(F.explode(F.array(_pair("a", "b"), _pair("b", "a"))).alias("p")).select("p.*")


def _pair(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("word"), F.col(f"{a}_n").alias("n"), F.col(b).alias("other"), F.col(f"{b}_n").alias("other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain, by pointer jumping. A form is several times as frequent as
    its word, so chains are short and end. Each round is stored in the shared folder. Stored words are several times as large
    in a broadcast as in their files, so joins sort."""
    reached = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = reached.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on"))
        moved = materialise(moved, "spelling-roots")
        if moved.filter("on").isEmpty():
            return moved.select("word", "root")
        reached = moved.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word. Runs its jobs; what it keeps between them is in the shared folder."""
    vocabulary = materialise(words(docs, key, text, shortest, least), "spelling-words")
    alone = vocabulary.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("other_n"))
    best = F.when(F.col("other").isNotNull(), F.struct(-F.col("other_n"), "other"))
    grouped = near_pairs(vocabulary).union(alone).groupBy("word", "n").agg(
        F.count("other").alias("n_near"), F.min_by(F.struct("other", "other_n"), best).alias("best")
    )
    fits = F.col("best.other_n") >= times * F.col("n")
    formed = materialise(
        grouped.select("word", "n", "n_near", F.when(fits, F.col("best.other")).alias("form"), F.when(fits, F.col("best.other_n")).alias("form_n")), "spelling-forms"
    )
    found = roots(formed.filter("form is not null"))
    whole = formed.join(found.hint("merge"), "word", "left")
    return whole.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
