"""Delimited records that may hold line breaks inside quotes, cut in many tasks.

A line read from outside a quoted field either completes its record or leaves a field open, and so does a line read from
inside one; both are found by one pattern match each. A split's effect is the composition of its lines' effects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowquarry.session import materialise
from rowquarry.sources.splits import by_split, chunks, joined_fragments

RECORDS = "file string, split long, place long, opens boolean, text string"


def _patterns(separator: str) -> tuple[str, str]:
    """What a line matches that ends outside quotes, read from outside and from inside a quoted field.

    A quote opens a field only at its start; inside, two quotes stand for one; what follows the closing quote is plain.
    """
    s = f"\\x{ord(separator):02x}"
    rest = rf'[^"]*+(?:""[^"]*+)*+"(?:[^{s}"][^{s}]*+)?+'
    field = rf'(?:"{rest}|(?:[^{s}"][^{s}]*+)?+)'
    more = rf"(?:{s}{field})*+\z"
    return rf"\A{field}{more}", rf"\A{rest}{more}"


def lines(spark: SparkSession, files: dict[str, list[str]], separator: str) -> DataFrame:
    """(file, split, text, from_outside, from_inside): every line, and whether it ends inside a quoted field."""
    outside, inside = _patterns(separator)
    text = F.col("text")
    quote = text.contains('"')
    return chunks(spark, files, "\n").select(
        "file", "split", "text", (quote & ~text.rlike(outside)).alias("from_outside"), (~(quote & text.rlike(inside))).alias("from_inside")
    )


def has_breaks(spark: SparkSession, files: dict[str, list[str]], separator: str) -> bool:
    """Whether any record goes on over a line break. Runs one job, which ends at the first such line."""
    return not lines(spark, files, separator).filter("from_outside").isEmpty()


def _states(state: int, from_outside: np.ndarray, from_inside: np.ndarray) -> np.ndarray:
    """State after each line: constant lines set it, lines that flip it count from the last constant one."""
    at = np.arange(len(from_outside))
    last = np.maximum.accumulate(np.where(from_outside == from_inside, at, -1))
    flips = np.cumsum(from_outside & ~from_inside)
    base = np.where(last >= 0, from_outside[last], bool(state))
    since = flips - np.where(last >= 0, flips[last], 0)
    return base ^ (since & 1).astype(bool)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own, effect = None, [0, 1]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [own[0]], "split": [own[1]], "outside": [effect[0]], "inside": [effect[1]]}, _EFFECT)

    for key, new, part in by_split(batches):
        if new:
            if own is not None:
                yield row()
            own, effect = key, [0, 1]
        marks = [part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)]
        effect = [int(_states(state, *marks)[-1]) for state in effect]
    if own is not None:
        yield row()


_EFFECT = pa.schema([("file", pa.string()), ("split", pa.int64()), ("outside", pa.int32()), ("inside", pa.int32())])


def _entered(effects: list) -> set[tuple[str, int]]:
    """The splits that begin inside a quoted field; an error if a file ends inside one."""
    found, file, state = set(), None, 0
    for r in [*sorted(effects, key=lambda r: (r["file"], r["split"])), None]:
        if r is None or r["file"] != file:
            if state:
                raise ValueError("a quoted field has no end")
            file, state = r and r["file"], 0
        if r is not None:
            if state:
                found.add((r["file"], r["split"]))
            state = r["inside"] if state else r["outside"]
    return found


def _cut(entered: set[tuple[str, int]], whole: bool):
    """Python stage giving whole records, or the fragments at the ends of splits. A file's first record is its header."""

    class Split:
        def __init__(self, key: tuple[str, int]):
            self.key, self.line = key, 0
            self.state = int(key in entered)
            self.open: list[str] = []
            self.head, self.place = bool(self.state), -1
            self.header = key[1] == 0  # still to come
            self.out: list[tuple[int, bool, str]] = []

        def record(self, place: int, text: str) -> None:
            if self.header and text.strip():
                self.header = False
            elif whole:
                self.out.append((place, True, text))

        def add(self, part: pa.RecordBatch) -> list[pa.RecordBatch]:
            text = part.column(4)
            after = _states(self.state, part.column(2).to_numpy(zero_copy_only=False), part.column(3).to_numpy(zero_copy_only=False))
            n, done = len(after), np.flatnonzero(~after)
            lead = 0
            if self.state:
                lead = int(done[0]) + 1 if len(done) else n
                self.open += text.slice(0, lead).to_pylist()
                if len(done):
                    self.close()
            batches = []
            if lead < n:
                first = np.append(lead, lead + 1 + np.flatnonzero(~after[lead : n - 1]))  # lines that begin a record
                ends = np.append(first[1:], n)
                opened = int(first[-1]) if after[-1] else n
                first, ends = first[first < opened], ends[first < opened]
                k = 0
                while self.header and k < len(first):
                    self.record(0, "\n".join(text.slice(int(first[k]), int(ends[k] - first[k])).to_pylist()))
                    k += 1
                first, ends = first[k:], ends[k:]
                if opened < n:
                    self.open, self.head = text.slice(opened).to_pylist(), False
                    self.place, self.header = -1 if self.header else self.line + opened, False
                if whole and len(first):
                    grouped = pa.ListArray.from_arrays(pa.array(np.append(first, ends[-1]) - first[0], pa.int32()), text.slice(int(first[0]), int(ends[-1] - first[0])))
                    batches.append(self.rows(self.line + first, [True] * len(first), pc.binary_join(grouped, "\n")))
            self.state, self.line = int(after[-1]), self.line + n
            return batches

        def close(self) -> None:
            """The open record ends here: a whole one, or the last of a fragment of an earlier split."""
            text, self.open = "\n".join(self.open), []
            if self.head:
                if not whole:
                    self.out.append((-1, False, text))
            elif self.place >= 0:
                self.record(self.place, text)
            self.head = False

        def rows(self, places, opens, text: pa.Array) -> pa.RecordBatch:
            n = len(text)
            columns = [pa.array([self.key[0]] * n, pa.string()), pa.array([self.key[1]] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(opens, pa.bool_())]
            return pa.RecordBatch.from_arrays([*columns, text.cast(pa.string())], ["file", "split", "place", "opens", "text"])

        def kept(self) -> list[pa.RecordBatch]:
            out, self.out = self.out, []
            return [self.rows([r[0] for r in out], [r[1] for r in out], pa.array([r[2] for r in out], pa.string()))] if out else []

        def end(self) -> list[pa.RecordBatch]:
            if self.open and not whole:
                self.out.append((self.place, not self.head, "\n".join(self.open)))
            return self.kept()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for key, new, part in by_split(batches):
            if new:
                if split is not None:
                    yield from split.end()
                split = Split(key)
            found = split.add(part)
            yield from split.kept()
            yield from found
        if split is not None:
            yield from split.end()

    return run


def records(spark: SparkSession, files: dict[str, list[str]], separator: str, breaks: bool) -> DataFrame:
    """(file, split, place, text) of every record but the files' headers and blank lines. With ``breaks`` runs two jobs:
    the splits' effects and the records that lie in several splits, which are stored."""
    found = lines(spark, files, separator)
    entered: set[tuple[str, int]] = set()
    if breaks:
        entered = _entered(found.select("file", "split", "from_outside", "from_inside").mapInArrow(_effects, "file string, split long, outside int, inside int").collect())
    else:
        found = found.select("file", "split", F.lit(False).alias("from_outside"), F.lit(False).alias("from_inside"), "text")
    found = found.select("file", "split", "from_outside", "from_inside", "text")
    whole = found.mapInArrow(_cut(entered, True), RECORDS)
    if entered:
        parts = found.mapInArrow(_cut(entered, False), RECORDS)
        whole = whole.drop("opens").union(materialise(joined_fragments(parts, "\n").filter("place >= 0").select("file", "split", "place", "text"), "records"))
    return whole.select("file", "split", "place", _without_return(F.col("text")).alias("text")).filter(F.trim("text") != "")


def _without_return(text: Column) -> Column:
    """A carriage return before the line break that ends a record is part of the break."""
    return F.when(text.endswith("\r"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(text)
