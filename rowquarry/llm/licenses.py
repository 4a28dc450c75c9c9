"""Licence scan: a trained paragraph classifier, confirmed against templates.

A paragraph goes to the next blank line. It is read twice in overlapping windows of WINDOW words: line by line, for short
notices, and over its line breaks, for notices that are wrapped. A softmax regression over hashed word 1-, 2- and 3-grams
gives each window a licence family or none. It learns from altered copies of the templates, from scrambled templates, and
from lines of a bounded sample of the corpus that resemble no template. The least probability that counts is calibrated on
all windows of the corpus that resemble no template: at most FALSE_RATE of them pass. A window that passes is compared with
the templates: enough word pairs of a likely family's confirm it; with some of any it is ``unknown``.

Defined results: null and empty texts have no paragraph and no family; repeated rows are scanned one by one; an
empty table gives no rows; null ids are carried; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.llm import texts

# Public licence notices, by family.
_GNU = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software"
    " Foundation{3} either version {4} of the License, or (at your option) any later version."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
TEMPLATES = {
    "agpl-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.", _GNU.format("program", ":", "Affero General Public License", ",", "3"),
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
    ],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work, CC0 1.0."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", _GNU.format("program", ";", "General Public License", ";", "2")],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", _GNU.format("program", ":", "General Public License", ",", "3")],
    "isc": ["Released under the ISC License.", _ISC + " the above copyright notice and this permission notice appear in all copies."],
    "lgpl-2.1": [_GNU.format("library", ";", "Lesser General Public License", ";", "2.1")],
    "lgpl-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.", _GNU.format("library", ":", "Lesser General Public License", ",", "3"),
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "mpl-2.0": [
        "This source code form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": ["All rights reserved."],
}
# The names that identifier lines give the families.
IDENTIFIERS = {
    "agpl-3.0": "AGPL-3.0-only", "apache-2.0": "Apache-2.0", "bsd-3-clause": "BSD-3-Clause", "cc-by-4.0": "CC-BY-4.0", "cc-by-nc-4.0": "CC-BY-NC-4.0",
    "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc0-1.0": "CC0-1.0", "gpl-2.0": "GPL-2.0-only", "gpl-3.0": "GPL-3.0-only", "isc": "ISC", "lgpl-2.1": "LGPL-2.1-only",
    "lgpl-3.0": "LGPL-3.0-only", "mit": "MIT", "mpl-2.0": "MPL-2.0",
}
MARK = "SPDX-License-Identifier: "
NONE = "none"
UNKNOWN = "unknown"
BUCKETS = 1 << 15
WINDOW, STEP = 40, 18
SAMPLE_DOCS = 600
SAMPLE_LINES = 8000  # of the sample documents; the driver gets no more
LINE_BYTES = 2048  # longer lines are not learned from
BINS = 2000  # of log odds from 0 to 40, for the calibration
COPIES = 75  # altered copies of each template
FALSE_RATE = 0.05  # of the windows without a look of a template, those that are compared with the templates all the same
LIKELY = 4  # families that the templates may choose between
CONFIRM = 0.6  # share of a template's word pairs
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = True
_IS_WORD[0x80:] = True


@dataclass
class LicenceModel:
    families: list[str]  # the last is NONE
    weights: np.ndarray
    bias: np.ndarray
    least: float


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def word_list(text: str | bytes) -> list[bytes]:
    return _WORD.findall((text.encode() if isinstance(text, str) else text).translate(_LOWER))


@dataclass
class Words:
    """The words of a block of texts and the windows over them. Word k owns the n-grams that end with it, within its
    paragraph; windows are ranges of words, first those of every line, then those of the paragraphs of several lines."""

    slots: np.ndarray  # of the 1-, 2- and 3-grams of each word; -1 for none
    starts: np.ndarray  # first byte of each word
    stops: np.ndarray
    of: np.ndarray  # text of each word
    by_line: tuple[np.ndarray, np.ndarray, np.ndarray]  # begin, end, whether the window begins a line
    across: tuple[np.ndarray, np.ndarray]
    paragraphs: np.ndarray  # of each text


def _cut(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping windows over units of words."""
    parts = np.maximum(1, -(-(length - WINDOW) // STEP) + 1)
    begin = np.repeat(first, parts) + STEP * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return begin, np.minimum(begin + WINDOW, np.repeat(first + length, parts))


def _units(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of every run of equal numbers."""
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) if len(unit) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(unit)))


def words_and_windows(data: np.ndarray, offsets: np.ndarray) -> Words:
    data = texts.LOWER[data]
    n = len(data)
    inside = _IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, stops = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    stops[:-1] &= ~inside[1:] | edge[1:n]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    of = texts.owner(offsets, starts)
    line = np.concatenate([[0], np.cumsum(data == 0x0A)])[starts] + of  # a text's end ends a line too
    paragraph = np.concatenate([[0], np.cumsum(_blank_lines(data))])[starts] + of
    word = texts.range_hash(texts.prefix_hash(data), starts, stops)
    slots = np.full((len(word), 3), -1, np.int64)
    for size in (1, 2, 3):
        if len(word) >= size:
            whole = np.arange(size - 1, len(word))
            whole = whole[paragraph[whole] == paragraph[whole - size + 1]]
            gram = np.zeros(len(whole), np.uint64)
            for k in range(size - 1, -1, -1):
                gram = gram * np.uint64(0x9E3779B97F4A7C15) + word[whole - k]
            slots[whole, size - 1] = (texts.mixed(gram + np.uint64(size)) >> np.uint64(49)).astype(np.int64)
    first, length = _units(line)
    begin, end = _cut(first, length)
    begins_line = np.zeros(len(word) + 1, bool)
    begins_line[first] = True
    units, sizes = _units(paragraph)
    several = line[units] != line[units + sizes - 1] if len(units) else np.zeros(0, bool)
    paragraphs = np.bincount(of[units], minlength=len(offsets) - 1)
    return Words(slots, starts, stops, of, (begin, end, begins_line[begin]), _cut(units[several], sizes[several]), paragraphs)


def _blank_lines(data: np.ndarray) -> np.ndarray:
    """Whether a byte is a line break that ends a line without any sign."""
    breaks = np.flatnonzero(data == 0x0A)
    seen = np.cumsum(~texts.IS_SPACE[data])[breaks]
    blank = np.zeros(len(data), bool)
    blank[breaks[1:][seen[1:] == seen[:-1]]] = True
    return blank


def sums(slots: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(running sums of the words' n-gram weights, the weights with a row of zeros at the end)."""
    padded = np.concatenate([weights, np.zeros((1, weights.shape[1]), np.float32)])
    total = np.zeros((len(slots) + 1, weights.shape[1]), np.float64)
    for size in range(3):
        total[1:] += padded[slots[:, size]]
    return np.cumsum(total, axis=0, out=total), padded


def logits(total: np.ndarray, begin: np.ndarray, end: np.ndarray, bias: np.ndarray, minus: np.ndarray | float = 0.0) -> np.ndarray:
    """Class scores of windows: the scaled sum of their n-grams' weights."""
    return (total[end] - total[begin] - minus) / np.sqrt(np.maximum(1, 3 * (end - begin)))[:, None] + bias


def over_breaks(slots: np.ndarray, padded: np.ndarray, begin: np.ndarray, end: np.ndarray, begins_line: np.ndarray) -> np.ndarray:
    """Weights of the n-grams of windows that begin a line which reach back over the line break."""
    second = np.where(end - begin > 1, begin + 1, begin)
    minus = padded[slots[begin, 1]] + padded[slots[begin, 2]] + padded[np.where(end - begin > 1, slots[second, 2], -1)]
    return np.where(begins_line[:, None], minus, np.float32(0))


def probabilities(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(1, keepdims=True))
    return scores / scores.sum(1, keepdims=True)


def word_pairs(text: str | bytes) -> set[tuple[bytes, bytes]]:
    words = word_list(text)
    return set(zip(words, words[1:]))


# Every template: its family, its number of word pairs, and the share of them that confirms it. Identifier lines must be whole.
_LISTED = [(family, word_pairs(t), CONFIRM) for family, listed in TEMPLATES.items() for t in listed]
_LISTED += [(family, word_pairs(MARK + name), 1.0) for family, name in IDENTIFIERS.items()]
_OF_PAIR: dict[tuple[bytes, bytes], list[int]] = {}
for _k, (_, _pairs, _) in enumerate(_LISTED):
    for _pair in _pairs:
        _OF_PAIR.setdefault(_pair, []).append(_k)
_MARK_PAIRS = word_pairs(MARK)


def _shared(own: set[tuple[bytes, bytes]]) -> dict[int, int]:
    """How many word pairs of each template a text has, for the templates of which it has any."""
    found: dict[int, int] = {}
    for pair in own.intersection(_OF_PAIR):
        for k in _OF_PAIR[pair]:
            found[k] = found.get(k, 0) + 1
    return found


def confirmed(text: str | bytes, ranked: list[str]) -> str | None:
    """The family, of the likely ones, whose template stands in a text most fully, if enough of it does and no
    other family's template stands there as fully. Of two that stand there alike, the one with more word pairs."""
    best: dict[str, tuple] = {}
    for k, n in _shared(word_pairs(text)).items():
        family, pairs, least = _LISTED[k]
        if n >= least * len(pairs):
            best[family] = max(best.get(family, (0.0, 0)), (n / len(pairs), len(pairs)))
    top = max(best, key=best.__getitem__, default=None)
    alike = [f for f in best if best[f] == best[top]] if top else []
    return top if top in ranked and len(alike) == 1 else None


def _unlike(text: str | bytes) -> bool:
    """Whether a text has less than three tenths of every template, and is no identifier line."""
    own = word_pairs(text)
    return all(n < 0.3 * len(_LISTED[k][1]) for k, n in _shared(own).items()) and not _MARK_PAIRS <= own


def _altered(rng: np.random.Generator, template: str, filler: list[str]) -> str:
    words = template.split()
    if len(words) > 6:
        words = [w for w in words if rng.random() > 0.05]
    extra = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, rng.choice([12, WINDOW])))]
    cut = int(rng.integers(0, len(extra) + 1))
    text = " ".join([*extra[:cut], *words, *extra[cut:]])
    return text.upper() if rng.random() < 0.1 else text


def _sample_lines(docs: DataFrame, key: str, text: str, sample: int) -> list[str]:
    """Lines with words of the ``sample`` documents of smallest hashed id, at most SAMPLE_LINES of at most LINE_BYTES.

    The ids are chosen first, without their texts; the lines are cut, made distinct and chosen in tasks.
    """
    ids = docs.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"))
    picked = ids.orderBy(F.xxhash64("id"), "id").limit(sample).distinct()
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")
    lines = rows.select(F.explode(F.split("text", "\n")).alias("line")).filter((F.octet_length("line") <= LINE_BYTES) & F.col("line").rlike("[^\\s]"))
    found = lines.distinct().orderBy(F.xxhash64("line"), "line").limit(SAMPLE_LINES).collect()
    return sorted(r["line"] for r in found if word_list(r["line"]))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS, seed: int = 13) -> LicenceModel:
    """Learn from the templates and from lines of ``sample`` documents; calibrate on all documents."""
    lines = _sample_lines(docs, key, text, sample)
    rng = np.random.default_rng(seed)
    listed = {f: [*TEMPLATES[f], *[MARK + IDENTIFIERS[f] for _ in range(f in IDENTIFIERS)]] for f in TEMPLATES}
    lines = [line for line in (lines[i] for i in rng.permutation(len(lines))) if _unlike(line)]
    filler = [w for line in lines[:500] for w in line.split()] or ["word"]
    families = [*sorted(TEMPLATES), NONE]
    made = [(_altered(rng, t, filler), families.index(f)) for f in families[:-1] for t in listed[f] for _ in range(COPIES)]
    scrambled = [t for ts in listed.values() for t in ts for _ in range(COPIES // 3)]
    made += [(" ".join(rng.permutation(t.split())[: rng.integers(1, 5)]), len(families) - 1) for t in scrambled]
    made += [(line, len(families) - 1) for line in lines]
    block = [m[0].replace("\n", " ").encode() for m in made]
    data, at = np.frombuffer(b"".join(block), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in block])])
    read = words_and_windows(data, at)
    slots, (begin, end, _) = read.slots, read.by_line
    y = np.array([m[1] for m in made])[read.of[begin]]
    row = np.repeat(np.arange(len(begin)), end - begin)
    places = np.concatenate([np.arange(a, b) for a, b in zip(begin, end)])
    scale = 1 / np.sqrt(3 * (end - begin))
    grams = slots[places]
    used = grams >= 0
    slot, of_row = grams[used], np.repeat(row, used.sum(1))
    by = np.argsort(slot, kind="stable")
    slot, of_row = slot[by], of_row[by]
    known, cut = np.unique(slot, return_index=True)
    weights, bias = np.zeros((BUCKETS, len(families)), np.float32), np.zeros(len(families))
    target, share = np.eye(len(families))[y], 1 / np.bincount(y, minlength=len(families)).clip(1)[y]
    pace = np.zeros((len(known), len(families)))
    for _ in range(60):
        p = probabilities(logits(sums(slots, weights)[0], begin, end, bias))
        slope = (p - target) * (share / share.mean() / len(y))[:, None]
        step = np.add.reduceat((slope * scale[:, None])[of_row], cut) + 1e-6 * weights[known]
        pace += step**2
        weights[known] -= (0.5 * step / np.sqrt(pace + 1e-12)).astype(np.float32)
        bias -= 2.0 * slope.sum(0)
    model = LicenceModel(families, weights, bias, 0.5)
    model.least = calibrated(docs, model, text)
    return model


def _scored(data: np.ndarray, at: np.ndarray, model: LicenceModel) -> Iterator[tuple]:
    """(of the windows: text, first byte, last byte, probabilities; paragraphs of each text): by lines, then across lines."""
    read = words_and_windows(data, at)
    total, padded = sums(read.slots, model.weights)
    begin, end, begins_line = read.by_line
    if len(begin):
        for some, stop, minus in ((begin, end, over_breaks(read.slots, padded, begin, end, begins_line)), (*read.across, 0.0)):
            p = probabilities(logits(total, some, stop, model.bias, minus)) if len(some) else np.zeros((0, len(model.families)))
            yield read.of[some], read.starts[some], read.stops[stop - 1], p, read.paragraphs
    else:
        yield *[np.zeros(0, np.int64)] * 3, np.zeros((0, len(model.families))), read.paragraphs


def _log_odds(p: np.ndarray) -> np.ndarray:
    """Log odds of any family against none."""
    return np.log(np.maximum(p[:, :-1].sum(1), 1e-300)) - np.log(np.maximum(p[:, -1], 1e-300))


def calibrated(docs: DataFrame, model: LicenceModel, text: str = "text") -> float:
    """The least probability, one half at least, that at most FALSE_RATE of all windows without a template's look reach;
    what a block of texts repeats counts once. One pass over all texts; tasks send counts by log odds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BINS + 2, np.int64)  # all windows, those by log odds, those above
        for _, data, at in texts.blocks(batches, "__text", max_rows=10_000):
            if not len(data):
                continue
            raw, prefix = data.tobytes(), texts.prefix_hash(data)
            for _, first, last, p, _ in _scored(data, at, model):
                once = np.unique(texts.range_hash(prefix, first, last), return_index=True)[1]
                first, last, p = first[once], last[once], p[once]
                counts[0] += len(p)
                odds = _log_odds(p)
                for k in np.flatnonzero(odds >= 0):
                    if _unlike(raw[first[k] : last[k]]):
                        counts[1 + min(BINS, int(odds[k] * (BINS / 40)))] += 1
                    else:
                        counts[0] -= 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS + 2)), pa.array(counts)], ["bin", "n"])

    sums = docs.select(F.col(text).alias("__text")).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    found = {r["bin"]: r["n"] for r in sums.collect()}
    passing = np.cumsum([found.get(k, 0) for k in range(BINS + 1, 0, -1)])[::-1]  # windows in a bin or above
    low = int(np.argmax(passing <= FALSE_RATE * found.get(0, 0))) if (passing <= FALSE_RATE * found.get(0, 0)).any() else BINS + 1
    return float(1 / (1 + np.exp(-low * 40 / BINS)))


def scan(docs: DataFrame, model: LicenceModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, n_paragraphs, families (confirmed, sorted), n_licensed and n_unknown windows, and score: the
    highest probability of any family."""
    schema = T.StructType([docs.select(*keep).schema[k] for k in keep]).add("n_paragraphs", "long")
    schema = schema.add("families", T.ArrayType(T.StringType())).add("n_licensed", "long").add("n_unknown", "long").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in texts.blocks(batches, "__text", max_rows=10_000):
            n = part.num_rows
            found: list[set] = [set() for _ in range(n)]
            licensed, unknown, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            lines = np.zeros(n, np.int64)
            if len(data):
                raw = data.tobytes()
                for of, first, last, p, lines in _scored(data, at, model):
                    top = 1 - p[:, -1]
                    np.maximum.at(score, of, top)
                    for k in np.flatnonzero(top >= model.least):
                        own = raw[first[k] : last[k]]
                        family = confirmed(own, [model.families[f] for f in np.argsort(-p[k, :-1])[:LIKELY]])
                        if family:
                            found[of[k]].add(family)
                            licensed[of[k]] += 1
                        elif not _unlike(own):
                            unknown[of[k]] += 1
            made = [pa.array(lines.astype(np.int64)), pa.array([sorted(f) for f in found], pa.list_(pa.string())), pa.array(licensed), pa.array(unknown), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
