"""Quality rules: statistics of each text, and robust multivariate outliers per language and source.

The minimum-covariance-determinant estimate of each (language, source) starts from medians and quartiles and takes
concentration steps: keep the three quarters of its rows nearest by Mahalanobis distance, take their mean and
covariance, repeat. Every step is two aggregations over all rows with partial sums; distances are cut at a bin of a
fine logarithmic histogram, so no group is ever sorted or gathered. Groups of few rows use the estimate of their
language, and small languages that of the whole table.

Defined results: null and empty texts have zero counts and fail the base rule; null languages and sources form
groups of their own; repeated rows each count; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.llm import texts
from rowquarry.session import fits_broadcast, materialise

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["f_words", "f_length", "f_symbols", "f_lines", "f_repeats"]
FLOORS = [1.0, 0.1, 0.5, 0.5, 0.5]  # least standard deviation of each feature
CORE = 0.75  # share of a group that the estimate rests on
STEPS = 3
MIN_ROWS = 50
CUT = 45.0  # squared distance beyond which a row is an outlier: chance about 1e-8 for 5 normal features
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of a block."""
    n = len(offsets) - 1
    zero = np.zeros(n, np.int64)
    if not len(data):
        return dict.fromkeys(COUNTS, zero)
    inside = ~texts.IS_SPACE[data]
    out = {"word_chars": per_text(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": per_text(_SYMBOL[data], offsets)}
    starts, ends = texts.words(data, offsets)
    of = texts.owner(offsets, starts)
    out["n_words"] = np.bincount(of, minlength=n)
    prefix = texts.prefix_hash(data)

    breaks = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    line_of = texts.owner(offsets, begin)
    stop = offsets[line_of + 1]
    after = np.searchsorted(breaks, begin)
    stop[after < len(breaks)] = np.minimum(stop, breaks[np.minimum(after, len(breaks) - 1)] if len(breaks) else stop)[after < len(breaks)]
    filled = np.concatenate([[0], np.cumsum(inside)])
    worded = filled[stop] > filled[begin]
    line_of = line_of[worded]
    key = texts.mixed(texts.range_hash(prefix, begin[worded], stop[worded]) + line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(line_of, minlength=n) - np.bincount(line_of[first], minlength=n)

    windows, first = texts.in_sequence(texts.range_hash(prefix, starts, ends), of, 5)
    key = texts.mixed(windows + of[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, index, count = np.unique(key, return_inverse=True, return_counts=True)
    again = first[count[index] > 1]
    cover = np.zeros(len(starts) + 6, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 5, -1)
    covered = np.cumsum(cover)[: len(starts)] > 0
    out["n_repeat_words"] = np.bincount(of[covered], minlength=n)
    return {k: out[k].astype(np.int64) for k in COUNTS}


def statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the counts of every row."""
    schema = T.StructType([docs.select(*keep).schema[k] for k in keep])
    for name in COUNTS:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in texts.blocks(batches, "__text", 4 << 20, 4096):
            made = text_counts(data, at)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(made[c]) for c in COUNTS)], schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def features() -> list[Column]:
    """Transformed statistics: logarithms of the size and of rates that short texts cannot make extreme."""
    def rate(count: str) -> Column:
        return F.log1p(100 * F.col(count) / (F.col("n_words") + 30))

    return [
        F.log1p("n_words").alias("f_words"),
        F.log((F.col("word_chars") + 180) / (F.col("n_words") + 30)).alias("f_length"),
        rate("n_symbols").alias("f_symbols"),
        rate("n_dup_lines").alias("f_lines"),
        rate("n_repeat_words").alias("f_repeats"),
    ]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _chi_square(p: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.linspace(1e-9, 80, 400_001)
    density = x ** (p / 2 - 1) * np.exp(-x / 2)
    return x, np.cumsum(density) / density.sum()


def consistency(p: int = len(FEATURES), core: float = CORE) -> float:
    """Factor that makes the covariance of the nearest ``core`` share of a normal sample that of the sample."""
    x, below = _chi_square(p)
    cut = x[np.searchsorted(below, core)]
    x, below = _chi_square(p + 2)
    return core / float(below[np.searchsorted(x, cut)])


_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def _distance() -> Column:
    """Squared Mahalanobis distance of a row from the estimate that was joined to it."""
    total: Column = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        a = F.col(FEATURES[i]) - F.col("mean")[i]
        b = F.col(FEATURES[j]) - F.col("mean")[j]
        total = total + a * b * F.col("precision")[k]
    return F.greatest(total, F.lit(0.0))


def _estimates(moments: DataFrame, scale: float) -> DataFrame:
    """(key, n, mean, precision) from (key, n, mean, cov) with variances kept above the floors."""
    floors = np.diag(np.square(FLOORS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for flat in frame["cov"]:
                full = np.zeros((len(FEATURES), len(FEATURES)))
                for value, (i, j) in zip(flat, _PAIRS):
                    full[i, j] = full[j, i] = value
                inverse = np.linalg.inv(scale * full + floors)
                made.append([float(inverse[i, j]) * (1 if i == j else 2) for i, j in _PAIRS])
            yield pd.DataFrame({"key": frame["key"], "n": frame["n"], "mean": frame["mean"], "precision": made})

    return moments.mapInPandas(run, "key string, n long, mean array<double>, precision array<double>")


def _key(level: int) -> Column:
    return F.to_json(F.struct(F.lit(level).alias("level"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source")[: 2 - level]]))


def _attach(rows: DataFrame, few: DataFrame) -> DataFrame:
    """Join what is known of each group to its rows: sent to all tasks if measured small, else by shuffle."""
    return rows.join(F.broadcast(few) if fits_broadcast(few) else few, "key")


def estimates(rows: DataFrame, core: float = CORE, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimates (key, n, mean, precision) of the rows of each key."""
    quartiles = [F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"q_{f}") for f in FEATURES]
    start = rows.groupBy("key").agg(F.count("*").alias("n"), *quartiles)
    spread = [((F.col(f"q_{f}")[2] - F.col(f"q_{f}")[0]) / 1.349) for f in FEATURES]
    cov = [F.pow(spread[i], 2) if i == j else F.lit(0.0) for i, j in _PAIRS]
    moments = start.select("key", "n", F.array(*[F.col(f"q_{f}")[1] for f in FEATURES]).alias("mean"), F.array(*cov).alias("cov"))
    found = materialise(_estimates(moments, 1.0), "mcd")
    for _ in range(steps):
        far = _attach(rows, found.select("key", "mean", "precision")).select(
            "key", *FEATURES, F.floor(F.log2(_distance() + 1e-6) * 16).cast("int").alias("bin")
        )
        histogram = far.groupBy("key", "bin").agg(F.count("*").alias("n"))
        by_bin = Window.partitionBy("key").orderBy("bin")
        cuts = (
            histogram.withColumn("below", F.sum("n").over(by_bin))
            .withColumn("all", F.sum("n").over(Window.partitionBy("key")))
            .filter(F.col("below") >= F.ceil(F.col("all") * core))
            .groupBy("key")
            .agg(F.min("bin").alias("cut"), F.max("all").alias("all"))
        )
        near = _attach(far, materialise(cuts, "mcd-cuts")).filter(F.col("bin") <= F.col("cut"))
        sums = near.groupBy("key").agg(
            F.max("all").alias("n"),
            F.count("*").cast("double").alias("m"),
            *[F.sum(f).alias(f"s_{f}") for f in FEATURES],
            *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"s_{i}_{j}") for i, j in _PAIRS],
        )
        mean = [F.col(f"s_{f}") / F.col("m") for f in FEATURES]
        cov = [F.col(f"s_{i}_{j}") / F.col("m") - mean[i] * mean[j] for i, j in _PAIRS]
        moments = sums.select("key", "n", F.array(*mean).alias("mean"), F.array(*cov).alias("cov"))
        found = materialise(_estimates(moments, consistency(core=core)), "mcd")
    return found


def judge(docs: DataFrame, keep: list[str], cut: float = CUT, text: str = "text") -> DataFrame:
    """``keep`` columns, the counts, base_failed, distance (squared) and kept. ``docs`` has lang and source. Runs
    the estimation's jobs; the texts are read once, their statistics written to the shared folder."""
    named = docs.select(*keep, *[c for c in ("lang", "source", text) if c not in keep])
    stats = materialise(statistics(named, [*keep, *[c for c in ("lang", "source") if c not in keep]], text), "statistics")
    stats = stats.select("*", *features())
    rows = stats.select(F.explode(F.array(*[_key(level) for level in range(3)])).alias("key"), *FEATURES)
    found = estimates(rows)
    groups = stats.groupBy("lang", "source").agg(F.count("*").alias("n0")).withColumn("n1", F.sum("n0").over(Window.partitionBy("lang")))
    level = F.when(F.col("n0") >= MIN_ROWS, _key(0)).when(F.col("n1") >= MIN_ROWS, _key(1)).otherwise(_key(2))
    use = groups.select(_key(0).alias("group"), level.alias("key")).join(found, "key").select(F.col("group").alias("key"), "mean", "precision")
    use = materialise(use, "mcd-use")
    judged = _attach(stats.withColumn("key", _key(0)), use).withColumn("distance", _distance())
    return judged.select(
        *keep, *COUNTS, base_failed().alias("base_failed"), "distance", (~base_failed() & (F.col("distance") <= cut)).alias("kept")
    )
