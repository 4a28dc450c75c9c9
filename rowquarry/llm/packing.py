"""Best-fit packing of tokenised documents into sequences of bounded tokens, documents and attention cost.

A document's tokens and an end mark are cut into pieces only if they are more than a sequence holds; the first piece
may then be shorter, so at most one piece of a document needs a partner. A piece is a vector: tokens, one document,
and attention cost (length squared). Pieces, longest first, go to the open sequence that holds them in every
dimension and scores best: the weighted dot product of piece and what is left, or the smallest norm of what would be
left. Pieces are dealt over shards of bounded size and packed shard by shard; nothing but lengths is shuffled.

Defined results: a null or empty text is its end mark alone; repeated rows are packed as rows of their own; null
ids are carried; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.llm import texts
from rowquarry.session import materialise

TOKENIZER = "byte_bpe_50k.json"
END = 0
SHARD_PIECES = 8192
SLOTS = 1 << 21  # of a worker's table of remembered parts: 14 bytes each, and 10 for ids; 50 MB in all
# Bytes of the Latin letters up to U+017F, and ASCII marks other than the apostrophe: always cut between the two.
_LETTERS = np.array([chr(b).isalpha() and b < 128 or 0x80 <= b <= 0xBF or b in (0xC3, 0xC4, 0xC5) for b in range(256)])
_MARKS = np.array([0x20 < b < 0x7F and not chr(b).isalnum() and chr(b) != "'" for b in range(256)])

_ODD_SPACE = re.compile(r"\A\s|\s\Z|\s\s")  # any other text can be cut at its spaces and line breaks
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_RARE_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_SPACES = np.array([b < 128 and chr(b).isspace() for b in range(256)])
_RARE_BYTES = {c.encode() for c in _RARE_SPACES if ord(c) > 127}
_RARE_LEADS = np.array([any(x[0] == b for x in _RARE_BYTES) for b in range(256)])


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents, attention cost; and how much each dimension weighs in a score."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)
    rule: str = "norm"  # or "dot"


def odd_space(text: str) -> bool:
    """Whether a text starts or ends with white space or holds two such characters in a row."""
    if text[:1].isspace() or text[-1:].isspace() or any(pair in text for pair in _PAIRS):
        return True
    return any(c in text for c in _RARE_SPACES) and _ODD_SPACE.search(text) is not None


def _cut_marks(data: np.ndarray, at: np.ndarray, of: np.ndarray, start: np.ndarray) -> None:
    """Also begin a part at the first mark of every part that is at most one space, Latin letters, then marks alone:
    most words come with several marks, and no token spans the two."""
    first = np.flatnonzero(start)
    if not len(first):
        return
    last = np.minimum(np.append(first[1:], len(data)), at[of[first] + 1])
    letter, mark = _LETTERS[data], _MARKS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    letter[lead[(data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7)]] = False  # the signs of multiplication and division
    letters, marks = (np.append(0, np.cumsum(c, dtype=np.int32)) for c in (letter, mark))
    space = (data[first] == 0x20).astype(np.int64)
    n_letters, n_marks = letters[last] - letters[first], marks[last] - marks[first]
    cut = first + space + n_letters  # where the marks begin, if all letters come first
    fits = (n_letters > 0) & (n_marks > 0) & (space + n_letters + n_marks == last - first)
    fits &= marks[np.minimum(cut, last)] == marks[first]
    start[cut[fits]] = True


class IdTable:
    """Token ids of remembered parts, found by the 64-bit hashes of their bytes for many parts at once: an open-addressing
    table of hashes, each with the place and number of its ids in one pool. Its size in bytes is fixed; when three fifths
    of it are taken, or the pool is full, it forgets all."""

    def __init__(self, slots: int = SLOTS):
        self.mask = np.uint64(slots - 1)
        self.keys, self.start, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.uint16)
        self.pool = np.zeros(5 * slots // 2, np.uint32)
        self.clear()

    def clear(self) -> None:
        self.keys[:] = 0
        self.n = self.used = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1."""
        found = np.full(len(hashes), -1, np.int64)
        left, slot = np.arange(len(hashes)), hashes & self.mask
        while len(left):
            seen = self.keys[slot]
            hit = seen == hashes[left]
            found[left[hit]] = slot[hit].astype(np.int64)
            on = ~hit & (seen != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        return found

    def fits(self, parts: int, ids: int) -> bool:
        return 5 * (self.n + parts) <= 3 * len(self.keys) and self.used + ids <= len(self.pool)

    def add(self, hashes: np.ndarray, ids: list[np.ndarray]) -> None:
        """Remember new, distinct hashes; there must be room."""
        sizes = np.array([len(x) for x in ids], np.int32)
        starts = self.used + np.cumsum(sizes) - sizes
        if len(ids):
            self.pool[self.used : self.used + int(sizes.sum())] = np.concatenate(ids)
        self.used, self.n = self.used + int(sizes.sum()), self.n + len(ids)
        left, slot = np.arange(len(hashes)), hashes & self.mask
        while len(left):
            free = self.keys[slot] == 0
            _, first = np.unique(np.where(free, slot, len(self.keys) + np.arange(len(slot))), return_index=True)
            mine = np.zeros(len(left), bool)
            mine[first] = True
            mine &= free
            at = slot[mine].astype(np.int64)
            self.keys[at], self.start[at], self.size[at] = hashes[left[mine]], starts[left[mine]], sizes[left[mine]]
            left, slot = left[~mine], (slot[~mine] + np.uint64(1)) & self.mask


class Encoder:
    """Token ids of texts, remembering the ids of parts over a worker's tasks in a table of bounded bytes.

    Byte-level tokenisers of this family never join a token over a single space that follows a character other
    than white space, nor over a single line break between two such characters. Texts are cut there; each distinct
    part is encoded once. A text that starts or ends with white space or holds two such characters in a row is
    encoded whole, as is one that holds an added token's literal, which the file's defaults make that token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.literals = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.line_break_ids = self.ids("\n")
        (self.line_break,) = self.line_break_ids
        self.table = IdTable()

    def whole(self, text: str) -> bytes:
        return self.ids(text).astype("<u4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def has_literal(self, text: str) -> bool:
        return any(literal in text for literal in self.literals)

    def _encode(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of parts: encoded together, one a line, and cut at the line breaks' id."""
        joined = "\n".join(parts)
        if self.has_literal(joined):  # one that spans a line break
            return [self.ids(part) for part in parts]
        flat = self.ids(joined)
        stops = np.flatnonzero(flat == self.line_break)
        return [flat[a:b] for a, b in zip([0, *(stops + 1).tolist()], [*stops.tolist(), len(flat)], strict=True)]

    def _remember(self, hashes: np.ndarray, ids: list[np.ndarray]) -> None:
        _, first = np.unique(hashes, return_index=True)
        short = np.array([len(ids[k]) < 1 << 16 for k in first], bool)
        first = first[(self.table.find(hashes[first]) < 0) & (hashes[first] != 0) & short]
        total = sum(len(ids[k]) for k in first)
        if not self.table.fits(len(first), total):
            self.table.clear()
        if self.table.fits(len(first), total):
            self.table.add(hashes[first], [ids[k] for k in first])

    def _irregular(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which texts must be encoded whole."""
        if not len(data):
            return np.zeros(len(at) - 1, bool)
        space = _SPACES[data]
        odd = np.zeros(len(at) - 1, bool)
        full = np.flatnonzero(np.diff(at))
        odd[full] = space[at[full]] | space[at[full + 1] - 1]
        pairs = np.flatnonzero(space[1:] & space[:-1]) + 1  # second of two in a row; in two texts it starts one
        odd[texts.owner(at, pairs)] = True
        # White space beyond ASCII begins with one of four bytes; texts that hold any are looked at one by one.
        rare = np.flatnonzero(_RARE_LEADS[data])
        raw = data.tobytes()
        rare = [p for p in rare.tolist() if raw[p : p + 2] in _RARE_BYTES or raw[p : p + 3] in _RARE_BYTES]
        doubtful = set(texts.owner(at, np.array(rare, np.int64)).tolist())
        for literal in self.literals:
            if literal.encode() in raw:
                doubtful.update(range(len(at) - 1))
        for k in doubtful:
            if not odd[k]:
                text = raw[at[k] : at[k + 1]].decode("utf-8", "replace")
                odd[k] = odd_space(text) or self.has_literal(text)
        return odd

    def block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin), from the bytes of a block of texts."""
        odd = self._irregular(data, at)
        of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        start = (data == 0x20) | (data == 0x0A)
        start[1:] |= data[:-1] == 0x0A
        start[at[:-1][np.diff(at) > 0]] = True
        start &= ~odd[of]
        _cut_marks(data, at, of, start)
        first = np.flatnonzero(start)
        # A part ends where the next begins, or where its text does.
        last = np.minimum(np.append(first[1:], len(data)), at[of[first] + 1])
        hashes = texts.range_hash(texts.prefix_hash(data), first, last)
        slots = self.table.find(hashes)
        extra: list[np.ndarray] = []
        extra_at = np.zeros(len(first), np.int64)
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            distinct, where, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            raw = data.tobytes()
            parts = [raw[first[k] : last[k]].decode("utf-8", "replace") for k in missing[where]]
            at_break = parts.index("\n") if "\n" in parts else len(parts)
            extra = self._encode(parts[:at_break] + parts[at_break + 1 :])
            extra[at_break:at_break] = [self.line_break_ids] * (at_break < len(parts))
            self._remember(distinct, extra)
            slots = self.table.find(hashes)  # as the table may have forgotten
            extra_at[missing] = inverse
            lost = np.flatnonzero(slots < 0)
            if len(lost) and not np.isin(lost, missing).all():  # it forgot parts that it had found: begin again
                return self.block(data, at)
        known = slots >= 0
        own = np.array([len(x) for x in extra], np.int64)
        size = np.where(known, self.table.size[slots].astype(np.int64), own[extra_at] if len(extra) else 0)
        whole = {int(k): self.ids(data[at[k] : at[k + 1]].tobytes().decode("utf-8", "replace")) for k in np.flatnonzero(odd)}
        per_text = np.bincount(of[first], size, len(at) - 1).astype(np.int64)
        for k, ids in whole.items():
            per_text[k] = len(ids)
        begins = np.append(0, np.cumsum(per_text))
        pool = np.concatenate([self.table.pool[: self.table.used], *extra]) if len(extra) and not known.all() else self.table.pool
        extra_start = self.table.used + np.append(0, np.cumsum(own))[:-1]
        source = np.where(known, self.table.start[slots], extra_start[extra_at] if len(extra) else 0)
        # Where each part's ids go: after the ids of the parts before it in its text.
        before = np.cumsum(size) - size
        text_first = np.searchsorted(of[first], np.arange(len(at) - 1))
        base = np.append(before, size.sum())[np.minimum(text_first, len(before))]
        target = begins[of[first]] + before - base[of[first]]
        out = np.zeros(begins[-1], np.uint32)
        step = np.arange(int(size.sum())) - np.repeat(before, size)
        out[np.repeat(target, size) + step] = pool[np.repeat(source, size) + step]
        for k, ids in whole.items():
            out[begins[k] : begins[k + 1]] = ids
        return out, begins

    def many(self, given: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        ids, begins = self.block(*texts.text_bytes(pa.array(given, pa.large_string())))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(begins, begins[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """This worker's encoder of a tokeniser file; by default the public byte-level one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokens: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, and the row's place in its task."""
    schema = T.StructType([docs.select(key).schema[key]]).add("piece", "integer").add("start", "long").add("length", "long")
    schema = schema.add("ids_crc32", "long").add("__place", "long")
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, place = encoder(tokenizer), 0
        for batch, data, at in texts.blocks(batches, "__text"):
            ids, begins = encode.block(data, at)
            row, part, start, length, check = [], [], [], [], []
            for k, (low, high) in enumerate(zip(begins.tolist(), begins[1:].tolist())):
                n = high - low + 1
                cuts = [0, *range(n - (n - 1) // tokens * tokens, n + 1, tokens)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    row.append(k)
                    part.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc = zlib.crc32(ids[low + a : min(low + b, high)].astype("<u4", copy=False).data)
                    check.append(zlib.crc32(end, crc) if b == n else crc)
            places = pa.array(np.arange(place, place + len(row), dtype=np.int64))
            place += len(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(part, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(check, pa.int64()), places],
                schema.names,
            )
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(key), F.col(text).alias("__text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, longest pieces first."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weight = np.array(capacity.weights)
    left = np.zeros((len(lengths) + 1, 3))
    opened = 0
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    live = np.zeros(0, np.int64)  # sequences that can still take a piece
    shortest = int(lengths.min()) if len(lengths) else 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        need = np.array([size, 1, size * size], float)
        if (need > full).any():
            raise ValueError("a piece is larger than a sequence")
        room = left[live]
        fits = (room >= need).all(1)
        if fits.any():
            at = live[fits]
            after = (room[fits] - need) / full
            if capacity.rule == "dot":
                score = -((room[fits] / full) * (need / full) * weight).sum(1)
            else:
                score = (after * after * weight).sum(1)
            best = int(at[np.argmin(score)])
        else:
            best, opened = opened, opened + 1
            left[best] = full
            if size + shortest <= capacity.tokens:
                live = np.append(live, best)
        sequence[i], offset[i] = best, capacity.tokens - left[best, 0]
        left[best] -= need
        if left[best, 0] < shortest or left[best, 1] < 1:
            live = live[live != best]
    return sequence, offset


def pack(made: DataFrame, capacity: Capacity = Capacity(), shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Stored ``pieces`` with sequence_id and offset. Counts the pieces once. Full pieces are spread like all others,
    so that shards are alike; a shard is one task's work of about ``shard_pieces`` rows."""
    shards = max(1, -(-made.count() // shard_pieces))
    key = made.columns[0]
    spread = made.withColumn("__shard", F.pmod(F.xxhash64(F.col(key), "piece", "length", "ids_crc32", "__place"), F.lit(shards)))
    schema = T.StructType([f for f in made.schema.fields if f.name != "__place"]).add("sequence_id", "long").add("offset", "long")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "ids_crc32", "start", "__place"]).reset_index(drop=True)
        sequence, offset = best_fit(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=sequence + frame["__shard"].to_numpy() * (1 << 32), offset=offset)[schema.names]

    return spread.groupBy("__shard").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: Capacity = Capacity(), tokenizer: str | None = None) -> DataFrame:
    """Tokenise, cut and pack: one row per piece."""
    return pack(materialise(pieces(docs, key, text, capacity.tokens, tokenizer), "pieces"), capacity)
