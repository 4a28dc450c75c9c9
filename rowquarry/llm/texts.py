"""Arrow text columns as byte arrays: bounded blocks, words, and hashes of byte ranges, all in NumPy.

Every function looks at whole texts. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 256
_RATIO = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_RATIO, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is outside the learning set: crc32 of its id as text leaves 1 by 3. False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(
    batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = BLOCK_BYTES, max_rows: int = BLOCK_ROWS
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows whose texts hold about ``max_bytes`` at most (one longer text is a block of its own)."""
    for batch in batches:
        data, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(at, at[low] + max_bytes, "right")) - 1
            high = min(max(high, low + 1), low + max_rows, batch.num_rows)
            yield batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low]
            low = high


def owner(offsets: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Row of the block that holds each byte place."""
    return np.searchsorted(offsets, places, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run without ASCII white space; runs end where a text ends."""
    n = len(data)
    inside = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _RATIO, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash ratio and of its inverse, n at least."""
    return _powers(1 << max(20, int(n).bit_length()))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash, one entry more than bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range, the same wherever the bytes stand."""
    _, down = powers(len(prefix))
    return mixed((prefix[ends] - prefix[starts]) * down[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixer over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def in_sequence(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n hashes in a row within one text, and the index of the first of them."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(of[: len(of) - n + 1] == of[n - 1 :])
    total = np.zeros(len(first), np.uint64)
    for k in range(n):
        total = total * np.uint64(_RATIO) + hashes[first + k]
    return mixed(total), first


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
