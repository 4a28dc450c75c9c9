"""Quality classifier: naive Bayes features in a linear support vector machine.

A text is the set of its hashed n-grams: raw byte 2- and 3-grams, words, word pairs in which a repeated word is
written as a reference to the first,
and long runs of such references. Each indicator is scaled by its log-count ratio between the classes; the
scaled vectors, brought to unit length, train a hinge-loss model by dual coordinate descent. A logistic curve over
margins of documents kept aside turns margins into scores.

Defined results: null and empty texts get the score of the bias alone; repeated rows are scored one by one; an
empty table gives no rows; with no label, or labels of one class, every score is that class's share (0.5 without
labels); an id labelled both ways teaches nothing; no column but the text is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.llm import texts

BUCKETS = 1 << 16
SAMPLE = 2500  # labelled documents of each class, at most, that the model learns from
_DIGIT = np.arange(256, dtype=np.uint8)
_DIGIT[0x30:0x3A] = 0x30


@dataclass
class QualityModel:
    """Weight of each bucket times its ratio, its squared ratio, the bias, and the curve from margins to scores."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float


def marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text which buckets its n-grams fall in: a boolean table."""
    n = len(offsets) - 1
    seen = np.zeros(n * BUCKETS, bool)
    of = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) * BUCKETS
    plain = _DIGIT[data].astype(np.uint32)
    for size in (2, 3):
        last = len(plain) - size + 1
        if last < 1:
            continue
        code = np.zeros(last, np.uint32)
        for k in range(size):
            code = (code << np.uint32(8)) | plain[k : k + last]
        slot = (code * np.uint32(2654435761 + 2 * size)) >> np.uint32(16)
        same = of[:last] == of[size - 1 :]
        seen[of[:last][same] + slot[same]] = True
    starts, ends = texts.words(data, offsets)
    if len(starts):
        word = texts.range_hash(texts.prefix_hash(data), starts, ends)
        row = of[starts]
        seen[row + (word >> np.uint64(48)).astype(np.int64)] = True
        for back in (1, 2):
            a, b, r = word[:-back], word[back:], row[:-back]
            pair = texts.mixed(a * np.uint64(3 + 2 * back) + b)
            pair = np.where(a == b, np.uint64(back << 50), pair)
            same = r == row[back:]
            seen[(r + (pair >> np.uint64(48)).astype(np.int64))[same]] = True
        for back in (1, 2, 3, 4):  # longer n-grams made of references only
            equal = (word[:-back] == word[back:]) & (row[:-back] == row[back:])
            for length in (4, 16):
                run = np.cumsum(np.concatenate([[0], equal]))
                full = np.flatnonzero(run[length:] - run[:-length] == length)
                slot = int(texts.mixed(np.array([back * 64 + length], np.uint64))[0] >> np.uint64(48))
                seen[row[:-back][full] + slot] = True
    return seen.reshape(n, BUCKETS)


def dual_descent(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 1.0, rounds: int = 12, seed: int = 5
) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and bias (as one more feature of value 1) of sparse rows (buckets, values)."""
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            slope = y[i] * (w[at] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), c)
            change = (new - alpha[i]) * y[i]
            if change:
                alpha[i] = new
                w[at] += change * v
                bias += change
                moved = max(moved, abs(change))
        if moved < 1e-3:
            break
    return w, bias


def curve(margin: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the weighted logistic curve, by damped Newton steps; the slope stays positive."""
    a, b = 2.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        slope = x.T @ (weight * (p - positive)) + np.array([1e-3 * a, 0])
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-2])
        move = np.clip(np.linalg.solve(bend, slope), -1, 1)
        a, b = max(a - move[0], 0.05), b - move[1]
    return float(a), float(b)


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = SAMPLE
) -> QualityModel:
    """Learn from the documents that ``labels`` marks 0 or 1: ratios and model from at most ``sample`` of each class,
    those of smallest hashed id, weighted back to the classes' true shares. Runs a few small jobs."""
    marks = (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("top"))
        .filter("y = top")
        .drop("top")
    )
    share = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    everyone = sum(share.values())
    flat = QualityModel(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, 0.0)
    picks = None
    for y in (0, 1):
        own = marks.filter(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(sample)
        picks = own if picks is None else picks.unionByName(own)
    chosen = docs.select(key, text).join(F.broadcast(picks), key)  # at most 2 * sample rows

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in texts.blocks(batches, text):
            table = marked(data, at)
            buckets = [np.flatnonzero(r).astype(np.uint16).tobytes() for r in table]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.string()), part.column(2), pa.array(buckets, pa.binary())], ["id", "y", "buckets"]
            )

    got = chosen.mapInArrow(found, "id string, y int, buckets binary").orderBy("id", "buckets").toArrow()
    y = np.array(got.column("y").to_pylist(), dtype=int)
    if len(set(y.tolist())) < 2:
        part = share.get(1, 0) / everyone if everyone else 0.5
        flat.shift = float(np.log(max(part, 1e-9) / max(1 - part, 1e-9)))
        return flat
    sets = [np.frombuffer(b.as_py(), np.uint16).astype(np.int64) for b in got.column("buckets")]
    counts = np.ones((2, BUCKETS))
    for at, of in zip(sets, y):
        counts[of, at] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = []
    for at in sets:
        v = ratio[at]
        rows.append((at, v / max(float(np.sqrt(v @ v)), 1e-9)))
    aside = np.arange(len(rows)) % 4 == 3
    if min(np.bincount(y[aside], minlength=2)) < 5:
        aside[:] = False
    teach = np.flatnonzero(~aside)
    w, bias = dual_descent([rows[i] for i in teach], np.where(y[teach] == 1, 1.0, -1.0))
    judge = np.flatnonzero(aside) if aside.any() else teach
    margin = np.array([w[rows[i][0]] @ rows[i][1] + bias for i in judge])
    weight = np.array([share[k] / max(1, int((y[judge] == k).sum())) for k in y[judge]])
    slope, shift = curve(margin, (y[judge] == 1).astype(float), weight * len(judge) / weight.sum())
    return QualityModel(w * ratio, ratio**2, bias, slope, shift)


def score(docs: DataFrame, model: QualityModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and a score from 0 to 1 for every row of ``docs``."""
    schema = T.StructType([docs.select(*keep).schema[k] for k in keep]).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in texts.blocks(batches, "__text"):
            n = part.num_rows
            places = np.flatnonzero(marked(data, at))
            of, bucket = places // BUCKETS, places % BUCKETS
            along = np.bincount(of, model.weight[bucket], n)
            length = np.sqrt(np.bincount(of, model.square[bucket], n))
            margin = along / np.maximum(length, 1e-9) + model.bias
            made = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -60, 60)))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(made)], schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
