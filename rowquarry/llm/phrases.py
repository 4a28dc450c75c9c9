"""Phrase collocations: phrases of a few words, counted by multikey three-way quicksort of suffix pointers.

Every word of a text is a pointer to the suffix that starts there, whose symbols are its words up to the end of its
piece. A task sorts the pointers of a block to the wanted depth: each segment is parted by a pivot symbol into smaller,
equal and larger, and only the equal part goes on to the next symbol. The sizes of the equal partitions are the block's
counts. They travel as sorted runs, routed by language and all their words, so that all counts of a phrase meet; there
the same sort adds them up and partitions below the least count are abandoned.

Depths 1 and 2 are counted first. Deeper pointers are followed only where all shorter phrases inside are frequent: a
bitmap of the frequent ones, of at most ``MAX_BITS`` bits whatever the corpus, tells tasks which partitions to abandon.
It can only let too much through, never too little. A frequent word or phrase reaches its route once a block, not once
an occurrence, and no route holds more than the share of phrases that its hash gives it.

Defined results: null and empty texts hold no words; a null language is ``und``; repeated rows count again; ids are not
looked at; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.llm import texts
from rowquarry.operators.ranking import keep_best
from rowquarry.session import materialise

LONGEST = 3  # words
LEAST = 10  # occurrences
COVERED = 50  # per cent of a phrase's occurrences inside one longer phrase
ROUTE_BYTES = 8 << 20  # of text for each route
BLOCK_BYTES = 3 << 20
MAX_BITS = 1 << 26
UNKNOWN = "und"

BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAPS = BREAKS.copy()
GAPS[[0x20, 0x09]] = True
RUN = T.StructType().add("lang", "string").add("depth", "integer").add("route", "long").add("phrases", "binary").add("counts", "binary")
COUNTED = T.StructType().add("lang", "string").add("depth", "integer").add("phrase", "string").add("f", "long")


def multikey_quicksort(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in groups of equal symbols, and where each group starts. ``symbols`` has one row for each depth.

    All open segments of a round are parted at once. A segment's pivot is the middle of three of its own symbols.
    """
    depths, n = symbols.shape
    pointers = np.arange(n)
    edge = np.zeros(n + 1, bool)
    edge[[0, n]] = True
    rng = np.random.default_rng(n)
    low, high, at = (np.array([x], np.int64) for x in (0, n, 0))
    while len(low := low[keep := high - low > 1]):
        high, at = high[keep], at[keep]
        size = high - low
        first = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(low)), size)
        place = np.arange(size.sum()) + (low - first)[segment]
        held = pointers[place]
        key = symbols[at[segment], held]
        three = np.sort([key[first + (rng.random(len(low)) * size).astype(np.int64)] for _ in range(3)], axis=0)
        pivot = three[1][segment]
        smaller, larger = key < pivot, key > pivot
        n_smaller, n_larger = np.add.reduceat(smaller, first, dtype=np.int64), np.add.reduceat(larger, first, dtype=np.int64)
        cut, end = low + n_smaller, high - n_larger
        for side, start in ((smaller, low), (~(smaller | larger), cut), (larger, end)):
            where = np.flatnonzero(side)
            owner = segment[where]
            rank = np.arange(len(where))
            begins = np.searchsorted(owner, np.arange(len(low)))
            pointers[start[owner] + rank - begins[owner]] = held[where]
        edge[cut] = edge[end] = True
        deeper = at + 1 < depths
        low, high, at = (
            np.concatenate([low, cut[deeper], end]),
            np.concatenate([cut, end[deeper], high]),
            np.concatenate([at, at[deeper] + 1, at]),
        )
    return pointers, np.flatnonzero(edge[:n])


class Block:
    """The words of some texts: their codes, their bytes, and whether the next word is in the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = texts.LOWER[data]
        inside = ~GAPS[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:n]
        ends[:-1] &= ~inside[1:] | edge[1:n]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.of = texts.owner(offsets, starts)
        piece = np.cumsum(BREAKS[data])[starts] if n else starts
        self.joined = (self.of[1:] == self.of[:-1]) & (piece[1:] == piece[:-1])
        self.n = len(starts)
        at = np.zeros(self.n + 1, np.int64)
        np.cumsum(ends - starts, out=at[1:])
        coded = _strings(data[inside], at).dictionary_encode()
        self.codes, self.words = coded.indices.to_numpy(), coded.dictionary

    def pointers(self, depth: int) -> np.ndarray:
        """The words that start ``depth`` words of one piece."""
        whole = np.ones(max(0, self.n - depth + 1), bool)
        for k in range(depth - 1):
            whole &= self.joined[k : k + len(whole)]
        return np.flatnonzero(whole)

    def text(self, pointers: np.ndarray, depth: int) -> pa.Array:
        parts = [self.words.take(pa.array(self.codes[pointers + k])) for k in range(depth)]
        return pc.binary_join_element_wise(*parts, _text(" ")) if depth > 1 else parts[0]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.LargeStringArray:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return texts.text_bytes(strings.cast(pa.large_string()))


def _hashes(phrases: pa.Array) -> np.ndarray:
    """64-bit hash of each phrase, the same in every task."""
    data, at = _buffers(phrases)
    return texts.range_hash(texts.prefix_hash(data), at[:-1], at[1:])


def _runs(lang: str, depth: int, phrases: pa.Array, counts: np.ndarray, routes: int) -> Iterator[tuple]:
    """One row for each route: its phrases, one a line, and their counts."""
    route = (_hashes(phrases) % np.uint64(routes)).astype(np.int64)
    order = np.argsort(route, kind="stable")
    data, at = _buffers(pc.binary_join_element_wise(phrases.take(pa.array(order)), _text(""), _text("\n")))
    route, counts = route[order], counts[order]
    cuts = np.append(np.flatnonzero(np.diff(route, prepend=-1)), len(route))
    for a, b in zip(cuts, cuts[1:]):
        yield lang, depth, int(route[a]), data[at[a] : at[b]].tobytes(), counts[a:b].tobytes()


def _count_blocks(docs: DataFrame, depths: tuple[int, ...], routes: int, bitmap=None) -> DataFrame:
    """Runs of every block's counts at these depths. With a bitmap, only phrases whose parts are in it."""

    def wanted(block: Block, pointers: np.ndarray, depth: int, lang: str) -> np.ndarray:
        bits, salt = bitmap.value, _salt(lang)
        for k in range(2):  # the phrase without its last and without its first word
            found = block.text(pointers + k, depth - 1)
            h = texts.mixed(_hashes(found) ^ salt) % np.uint64(8 * len(bits))
            pointers = pointers[(bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return pointers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, at in texts.blocks(batches, "text", BLOCK_BYTES, 1 << 20):
            block, langs = Block(data, at), part.column(0).dictionary_encode()
            own = langs.indices.to_numpy()[block.of] if block.n else np.zeros(0, np.int32)
            rows = []
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                for depth in depths:
                    pointers = block.pointers(depth)
                    pointers = pointers[own[pointers] == code]
                    if bitmap is not None:
                        pointers = wanted(block, pointers, depth, lang)
                    if len(pointers):
                        order, starts = multikey_quicksort(np.stack([block.codes[pointers + k] for k in range(depth)]))
                        sizes = np.diff(np.append(starts, len(pointers)))
                        rows += _runs(lang, depth, block.text(pointers[order[starts]], depth), sizes, routes)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW_RUN)], RUN.names)

    return docs.mapInArrow(run, RUN)


_ARROW_RUN = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary())


def _salt(lang: str) -> np.uint64:
    return _hashes(pa.array([lang + "\n"], pa.large_string()))[0]


def _add_up(runs: DataFrame, least: int) -> DataFrame:
    """(lang, depth, phrase, f) of every phrase found ``least`` times or more, and for each language rows of depth 0
    whose f adds up to its number of words."""

    def run(table: pa.Table) -> pa.Table:
        lang, depth = table.column(0)[0].as_py(), table.column(1)[0].as_py()
        data = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8)
        counts = np.frombuffer(b"".join(table.column(4).to_pylist()), np.int64)
        ends = np.flatnonzero((data == 0x20) | (data == 0x0A))  # of words: each ends with one of the two
        at = np.zeros(len(ends) + 1, np.int64)
        np.cumsum(np.diff(ends, prepend=-1) - 1, out=at[1:])
        coded = _strings(np.delete(data, ends), at).dictionary_encode()
        symbols = coded.indices.to_numpy().reshape(-1, depth).T
        order, starts = multikey_quicksort(symbols)
        f = np.add.reduceat(counts[order], starts)
        often = np.flatnonzero(f >= least)
        first = order[starts[often]]
        words = [coded.dictionary.take(pa.array(symbols[k, first])) for k in range(depth)]
        phrases = pc.binary_join_element_wise(*words, _text(" ")) if depth > 1 else words[0]
        phrases, f, depths = phrases.cast(pa.string()).to_pylist(), f[often].tolist(), [depth] * len(often)
        if depth == 1:
            phrases, f, depths = [*phrases, ""], [*f, int(counts.sum())], [*depths, 0]
        return pa.table([pa.array([lang] * len(f), pa.string()), pa.array(depths, pa.int32()), pa.array(phrases, pa.string()), pa.array(f, pa.int64())], COUNTED.names)

    return runs.groupBy("lang", "depth", "route").applyInArrow(run, COUNTED)


def _bitmap(frequent: DataFrame, n: int) -> np.ndarray:
    """Bitmap of phrases (lang, phrase), 16 bits for each, up to the bound. Tasks set bits, which are merged byte by byte."""
    size = min(MAX_BITS, 1 << max(13, int(16 * n).bit_length())) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            if batch.num_rows:
                langs = batch.column(0).dictionary_encode()
                salt = np.array([_salt(x) for x in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
                h = texts.mixed(_hashes(batch.column(1)) ^ salt) % np.uint64(8 * size)
                np.bitwise_or.at(bits, (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8))
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(bits[some].astype(np.int16))], ["at", "bits"])

    merged = frequent.select("lang", "phrase").mapInArrow(run, "at long, bits short").groupBy("at").agg(F.expr("bit_or(bits) AS bits"))
    found = merged.toArrow()  # at most ``size`` rows
    bits = np.zeros(size, np.uint8)
    bits[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint8)
    return bits


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, depth, phrase, f) of all phrases of up to ``longest`` words found ``least`` times or more in a language;
    rows of depth 0 add up to the language's words. Reads the texts once for depths 1 and 2 and once for each further depth."""
    spark = docs.sparkSession
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = max(1, -(-size // ROUTE_BYTES))
    found = [materialise(_add_up(_count_blocks(read, (1, 2)[:longest], routes), least), "phrase-counts")]
    for depth in range(3, longest + 1):
        shorter = found[-1].filter(F.col("depth") == depth - 1)
        bitmap = spark.sparkContext.broadcast(_bitmap(shorter, shorter.count()))
        found.append(materialise(_add_up(_count_blocks(read, (depth,), routes, bitmap), least), "phrase-counts"))
    return reduce(DataFrame.union, found)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two words or more of every language.

    A phrase's score is that of its weakest cut in two. Phrases half of whose occurrences lie inside one longer
    candidate are left out. Runs the counting jobs; the rest are joins of counts by language and phrase.
    """
    counted = counts(docs, text, lang, longest, least)
    total = counted.filter("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = counted.filter("depth > 0").select("lang", "phrase", "f")
    candidates = counted.filter("depth > 1").select("lang", "phrase", "depth", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = candidates.select("lang", "phrase", "depth", "a", "w", F.explode(F.sequence(F.lit(1), F.col("depth") - 1)).alias("k"))
    cut = cut.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("depth") - F.col("k")), " ").alias("right"),
    )
    left = frequent.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    both = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    wide = "CAST({} AS DECIMAL(15, 0))".format
    both = both.withColumn(
        "score", F.expr(f"({wide('a')} * {wide('a')} * CAST(1000000 AS DECIMAL(7, 0))) div ({wide('l')} * {wide('r')})")
    )
    weakest = both.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("c"))
    weakest = weakest.select("lang", "phrase", "c.*")
    # Every shorter candidate inside a candidate, with the longer one's count.
    inner = candidates.filter("depth > 2").select("a", "lang", "w", "depth", F.explode(F.sequence(F.lit(2), F.col("depth") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("depth") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", "a", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < COVERED * F.col("a"), F.lit(True)))
    best = keep_best(kept, [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], top, "lang")
    return best.join(F.broadcast(total), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
