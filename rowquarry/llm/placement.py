"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table, a permutation given by an offset
and a step. Shards take turns, each claiming the first slot of its order that is still free, until the table is
full. A key's slot is its hash modulo the table size, so placing a key is one look into an array that is sent to
every task; adding or removing a shard moves few keys besides its own.

Defined results: a null key is placed like any key (all null keys share a slot); repeated keys share a shard; an
empty table gives no rows; other columns pass through. A column of the user's that is called ``slot`` or ``shard`` is kept
under that name with ``_given``.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowquarry.functions.text import quoted
from rowquarry.operators.clean import unique_names

SLOTS = 65_537  # a prime; at most SLOTS entries are sent to each task
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> np.ndarray:
    """Index of the shard that owns each slot. The table has a prime size, at least that of the shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the table size must be a prime no smaller than the number of shards")
    orders = []
    for name in shards:
        offset, step = _number(f"offset:{name}") % slots, _number(f"step:{name}") % (slots - 1) + 1 if slots > 2 else 1
        orders.append((offset + step * np.arange(slots, dtype=np.int64)) % slots)
    table, at, filled = np.full(slots, -1, np.int64), [0] * len(shards), 0
    while filled < slots:
        for k, order in enumerate(orders):
            while table[order[at[k]]] >= 0:
                at[k] += 1
            table[order[at[k]]] = k
            filled += 1
            if filled == slots:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots))


def place(rows: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with slot and shard. Nothing is shuffled; the table of ``slots`` entries is broadcast."""
    spark = rows.sparkSession
    table = lookup_table(shards, slots)
    listed = spark.createDataFrame([(int(s), shards[k]) for s, k in enumerate(table)], "slot long, shard string")
    names = [f"{c}_given" if c.lower() in ("slot", "shard") else c for c in rows.columns]
    own = names[rows.columns.index(key)]
    placed = rows.toDF(*unique_names(names)).withColumn("slot", slot_of(quoted(own), slots))
    return placed.join(F.broadcast(listed), "slot")


def write_shards(rows: DataFrame, path: str, key: str = "doc_id", files_per_shard: int = 4, **how) -> None:
    """Write ``rows`` to one folder per shard. Each shard's rows are dealt over several tasks and files by a hash of the
    whole row, whichever keys they have, so a lost task deals them the same way again."""
    placed = place(rows, key, **how)
    whole = [F.xxhash64(F.to_json(F.struct(*[quoted(c) for c in placed.columns])))]
    salted = placed.withColumn("__file", F.pmod(*whole, F.lit(files_per_shard)))
    salted.repartition("shard", "__file").drop("__file", "slot").write.partitionBy("shard").parquet(path)
