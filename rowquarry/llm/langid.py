"""Language identification with error-correcting output codes.

Each learned language has a codeword of +1 and -1. One linear classifier over hashed byte n-grams predicts each
bit; a text gets the language whose codeword loses least against the predicted margins, bits weighing as much as
they were right in learning. A text whose best two codewords lose nearly the same is flagged ambiguous.

Defined results: null and empty texts and texts without any letter are ``und`` with score 0; repeated rows are
predicted one by one; an empty table gives no rows; columns other than the id and the text are not looked at;
with no learned language every text is ``und``; ties go to the language first by code point.
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

UNKNOWN = "und"
FEATURES = 1 << 12
SAMPLE = 2400  # learning documents in all, shared evenly by the languages
GAP = 0.02  # loss between the best two codewords, per bit weight, under which a text is ambiguous

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[0x41:0x5B] = _IS_LETTER[0x61:0x7B] = True


@dataclass
class LanguageModel:
    """Learned languages, their codewords, the bit classifiers and the weight of each bit."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray


def feature_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors of square-rooted counts of hashed 2- and 3-byte sequences, one row per text."""
    n, folded = len(offsets) - 1, _FOLD[data].astype(np.uint32)
    of = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.zeros(n * FEATURES)
    for size in (2, 3):
        if len(folded) < size:
            continue
        last = len(folded) - size + 1
        code = np.zeros(last, np.uint32)
        blank = np.zeros(last, np.uint8)
        for k in range(size):
            code = (code << np.uint32(8)) | folded[k : k + last]
            blank += folded[k : k + last] == 0x20
        same = (of[:last] == of[size - 1 :]) & (blank < 2)
        slot = ((code * np.uint32(2654435761 + 2 * size)) >> np.uint32(20)).astype(np.int64)
        counts += np.bincount(of[:last][same] * FEATURES + slot[same], minlength=n * FEATURES)
    rows = np.sqrt(counts).reshape(n, FEATURES).astype(np.float32)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_IS_LETTER[data])])
    found = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~found):
        if offsets[i + 1] > offsets[i]:
            found[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def codewords(n_languages: int, seed: int = 11) -> np.ndarray:
    """The seeded random code, of several, whose codewords lie farthest apart."""
    bits = max(15, 10 * int(np.ceil(np.log2(max(n_languages, 2)))))
    rng, best, best_gap = np.random.default_rng(seed), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1.0, 1.0]), (n_languages, bits))
        if n_languages > 1:
            flat = np.abs(code.sum(0)) == n_languages
            code[0, flat] *= -1
        gap = bits if n_languages < 2 else min(int((code[i] != code[j]).sum()) for i in range(n_languages) for j in range(i))
        if gap > best_gap:
            best, best_gap = code, gap
    return best


def fit_bits(rows: np.ndarray, targets: np.ndarray, rounds: int = 150, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic classifiers, one per column of targets, by accelerated gradient steps."""
    n = len(rows)
    w = np.zeros((rows.shape[1], targets.shape[1]), np.float32)
    b = np.zeros(targets.shape[1], np.float32)
    step, vw, vb = 6.0, np.zeros_like(w), np.zeros_like(b)
    for t in range(rounds):
        ahead, push = w + 0.9 * vw, b + 0.9 * vb
        margin = (rows @ ahead + push) * targets
        slope = (-targets / (1 + np.exp(np.clip(margin, -30, 30)))).astype(np.float32) / n
        vw = 0.9 * vw - step * (rows.T @ slope + ridge * ahead)
        vb = 0.9 * vb - step * 0.1 * slope.sum(0)
        w, b = w + vw, b + vb
    return w, b


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", order: str = "doc_id", sample: int = SAMPLE) -> LanguageModel:
    """Learn from the rows of ``docs`` with a language. The classifiers see at most ``sample`` texts, the same number
    of each language (those of smallest hashed id); the languages are those of all rows. Runs three small jobs."""
    known = docs.filter(F.col(lang).isNotNull() & (F.col(lang) != UNKNOWN))
    languages = sorted(r[0] for r in known.select(lang).distinct().collect())
    if not languages:
        return LanguageModel([], *[np.zeros((0, 0))] * 2, *[np.zeros(0)] * 2)
    each = max(1, sample // len(languages))
    picks = None
    for name in languages:
        own = known.filter(F.col(lang) == name).select(order).orderBy(F.xxhash64(order), order).limit(each)
        picks = own if picks is None else picks.unionByName(own)
    picks = picks.distinct()  # at most ``sample`` ids
    chosen = known.select(order, text, lang).join(F.broadcast(picks), order)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in texts.blocks(batches, text):
            made = feature_rows(data, at)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.string()), part.column(2), pa.array([r.tobytes() for r in made], pa.binary())], ["id", "lang", "row"]
            )

    got = chosen.mapInArrow(rows, "id string, lang string, row binary").orderBy("id", "lang", "row").toArrow()
    x = np.frombuffer(b"".join(got.column("row").to_pylist()), np.float32).reshape(-1, FEATURES)
    index = {name: i for i, name in enumerate(languages)}
    y = np.array([index[v] for v in got.column("lang").to_pylist()])
    codes = codewords(len(languages))
    w, b = fit_bits(x, codes[y])
    right = np.mean((x @ w + b) * codes[y] > 0, axis=0)
    weight = np.maximum(right - 0.5, 1e-3)
    return LanguageModel(languages, codes, w, b, weight / weight.sum())


def decode(model: LanguageModel, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(best language, second best, score, loss between them) by weighted logistic loss against every codeword."""
    margin = np.clip(rows @ model.weights + model.bias, -30, 30)
    loss = np.stack([(np.log1p(np.exp(-margin * code)) * model.bit_weight).sum(1) for code in model.codes], 1)
    chance = np.exp(-(loss - loss.min(1, keepdims=True)) * len(model.bit_weight))
    chance /= chance.sum(1, keepdims=True)
    ranked = np.argsort(loss, axis=1, kind="stable")
    at = np.arange(len(rows))
    second = ranked[:, min(1, loss.shape[1] - 1)]
    gap = loss[at, second] - loss[at, ranked[:, 0]] if loss.shape[1] > 1 else np.full(len(rows), np.inf)
    return ranked[:, 0], second, chance[at, ranked[:, 0]], gap


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text", gap: float = GAP) -> DataFrame:
    """``keep`` columns, and lang_pred, score, second, ambiguous for every row of ``docs``."""
    fields = [docs.select(*keep).schema[k] for k in keep]
    schema = T.StructType(fields).add("lang_pred", "string").add("score", "double").add("second", "string").add("ambiguous", "boolean")
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    source = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in texts.blocks(batches, text):
            n = part.num_rows
            spoken = has_letter(data, at) if model.languages else np.zeros(n, bool)
            best, second = np.full(n, len(names) - 1), np.full(n, len(names) - 1)
            score, close = np.zeros(n), np.zeros(n, bool)
            if spoken.any():
                b, s, p, g = decode(model, feature_rows(data, at))
                best[spoken], second[spoken], score[spoken] = b[spoken], s[spoken], p[spoken]
                close[spoken] = g[spoken] < gap
            made = [pa.array(names[best], pa.string()), pa.array(score), pa.array(names[second], pa.string()), pa.array(close)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], schema.names)

    return source.mapInArrow(run, schema)


def recognised(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is recognised: neither without letters nor
    ambiguous. Columns may have any names."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    judged = predict(plain, model, plain.columns, f"c{names.index(text)}")
    return judged.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select(*plain.columns).toDF(*names)
