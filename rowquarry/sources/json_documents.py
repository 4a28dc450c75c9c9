"""JSON documents of any size as rows of JSON text: the items of a list, or of several equal lists, in many tasks.

A list is read in pieces that end at a closing brace, an object in pieces that end at a comma, as its lists may hold no
brace at all; so a piece is a part of one item. Whether a piece begins inside a string and how deep it is nested
follows from the pieces before it; see ``splits``. Items are what lies between the commas of the wanted lists. A document
whose first sign is ``[`` is a list itself; the lists of one that begins with ``{`` are its members.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowquarry.functions import fixed
from rowquarry.session import materialise, materialise_compact
from rowquarry.sources.splits import buffers, by_split, chunks, decoded, joined_fragments, strings

ITEMS = "file string, split long, place long, opens boolean, kind int, list_no long, at long, text string"
_ITEM_NAMES = ["file", "split", "place", "opens", "kind", "list_no", "at", "text"]
OUTSIDE, LIST, OBJECT = 0, 1, 2  # what a piece of text between two cuts lies in


def marks(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(outside strings, +1 at opening and -1 at closing brackets outside strings, quotes, whether the end is inside)."""
    quote = data == 0x22
    back = np.flatnonzero(data == 0x5C)
    if len(back):
        first = np.flatnonzero(np.diff(back, prepend=-2) != 1)  # of each run of backslashes
        within = np.arange(len(back)) - np.repeat(first, np.diff(np.append(first, len(back))))
        after = back[within % 2 == 0] + 1
        quote[after[after < len(data)]] = False
    within = (np.cumsum(quote, dtype=np.int32) + int(inside)) & 1 == 1
    outside = ~within & ~quote
    step = np.zeros(len(data), np.int8)
    step[outside & ((data == 0x5B) | (data == 0x7B))] = 1
    step[outside & ((data == 0x5D) | (data == 0x7D))] = -1
    return outside, step, quote, bool(within[-1]) if len(data) else inside


def _piece_bytes(text: pa.Array, end: str) -> np.ndarray:
    large = text.cast(pa.large_string())
    return buffers(pc.binary_join_element_wise(large, pa.scalar("", pa.large_string()), pa.scalar(end, pa.large_string())))[0]


def pieces(spark: SparkSession, files: dict[str, list[str]]) -> tuple[DataFrame, str]:
    """(file, split, size, n_bytes, text) of the documents' pieces, and the sign that ends each. A job reads the first sign."""
    by_comma = chunks(spark, files, ",").select("file", "split", "size", "n_bytes", "text")
    first = F.substring(F.btrim("text", F.lit(" \t\r\n\ufeff")), 1, 1)
    sign = by_comma.select(first.alias("sign")).filter("sign <> ''").head()
    if sign and sign["sign"] == "{":
        return by_comma, ","
    return chunks(spark, files, "}").select(*by_comma.columns), "}"


def _balance(batches: Iterator[pa.RecordBatch], end: str) -> Iterator[pa.RecordBatch]:
    """What each split does: whether it flips being inside a string, and how it changes the depth either way."""
    own, held = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"file": [own[0]], "split": [own[1]], "size": [held[3]], "n_bytes": [held[4]], "flips": [held[0][0]], "outside": [held[1][0]], "inside": [held[1][1]], "first": [held[2]]},
            _BALANCE,
        )

    for key, new, part in by_split(batches):
        if new:
            if own is not None:
                yield row()
            own, held = key, [[False, True], [0, 0], "", 0, 0]
        text = part.column(4)
        if not held[2]:
            held[2] = next((t.lstrip("﻿ \t\r\n")[:1] for t in text.to_pylist() if t.strip("﻿ \t\r\n")), "")
        data = _piece_bytes(text, end)
        for k in (0, 1):
            _, step, _, held[0][k] = marks(data, held[0][k])
            held[1][k] += int(step.sum(dtype=np.int64))
        held[3] = part.column(2)[0].as_py()
        held[4] += int(pc.sum(part.column(3)).as_py())
    if own is not None:
        yield row()


_BALANCE = pa.schema(
    [("file", pa.string()), ("split", pa.int64()), ("size", pa.int64()), ("n_bytes", pa.int64()), ("flips", pa.bool_()), ("outside", pa.int64()),
     ("inside", pa.int64()), ("first", pa.string())]
)
_BALANCE_SQL = "file string, split long, size long, n_bytes long, flips boolean, outside long, inside long, first string"


@dataclass(frozen=True)
class Entry:
    """The state a split is entered in."""

    inside: bool = False
    depth: int = 0
    kind: int = OUTSIDE
    list_no: int = 0  # lists and objects opened at the wanted depth so far
    at: int = 0  # items of the current one before this split's first


def _entries(rows: list, end: str) -> tuple[dict[tuple[str, int], Entry], str]:
    """The state of each split, and the sign all documents begin with. An error if one does not end where its file does."""
    entries: dict[tuple[str, int], Entry] = {}
    firsts, by_file = set(), defaultdict(list)
    for r in rows:
        by_file[r["file"]].append(r)
    for file, parts in by_file.items():
        inside, depth, first = False, 0, ""
        for r in sorted(parts, key=lambda r: r["split"]):
            first = first or r["first"]
            entries[file, r["split"]] = Entry(inside, depth, LIST if first == "[" and depth else OUTSIDE)
            depth += r["inside"] if inside else r["outside"]
            inside ^= r["flips"]
        # The last piece of a file that ends with another sign was given one of its own; a byte order mark is not read.
        added = (sum(r["n_bytes"] for r in parts) - parts[0]["size"]) % 3 in (1, 2)
        if inside or depth != (-1 if added and end == "}" else 0) or (end == "," and not added):
            raise ValueError("the document is not complete")
        firsts.add(first)
    if len(firsts) != 1 or not firsts <= {"[", "{"}:
        raise ValueError("empty file" if firsts <= {""} else "not all documents are lists, nor all objects")
    return entries, firsts.pop()


class _Split:
    """Cuts the pieces of one split. ``want``: 'items' gives whole items of lists, 'ends' the fragments at the ends of the
    split and the texts outside of lists, each with the bracket that ends it, 'counts' one row with what the split did."""

    def __init__(self, key: tuple[str, int], entry: Entry, depth: int, want: str):
        self.key, self.wanted, self.want = key, depth, want
        self.inside, self.depth, self.kind, self.list_no, self.at = entry.inside, entry.depth, entry.kind, entry.list_no, entry.at
        self.pending: list[np.ndarray] = []  # what the current item holds so far
        self.place, self.head, self.fresh = 0, key[1] != 0, False
        self.opened, self.changed = 0, False

    def rows(self, place, opens, kind, list_no, at, text: pa.Array) -> pa.RecordBatch:
        n = len(text)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.key[0]] * n, pa.string()), pa.array([self.key[1]] * n, pa.int64()), pa.array(place, pa.int64()), pa.array(opens, pa.bool_()),
             pa.array(kind, pa.int32()), pa.array(list_no, pa.int64()), pa.array(at, pa.int64()), text], _ITEM_NAMES,
        )

    def row(self, place: int, opens: bool, text: str) -> pa.RecordBatch:
        return self.rows([place], [opens], [self.kind], [self.list_no], [self.at], pa.array([text], pa.string()))

    def held(self, until: np.ndarray) -> str:
        return b"".join(part.tobytes() for part in [*self.pending, until]).decode("utf-8", "replace")

    def add(self, data: np.ndarray) -> Iterator[pa.RecordBatch]:
        outside, step, _, self.inside = marks(data, self.inside)
        level = self.depth + np.cumsum(step, dtype=np.int32)
        self.depth = int(level[-1])
        opener, closer = (step == 1) & (level == self.wanted), (step == -1) & (level == self.wanted - 1)
        cuts = np.flatnonzero(opener | closer | (outside & (data == 0x2C) & (level == self.wanted)))
        if not len(cuts):
            self.pending.append(data)
            return
        opens, closes = opener[cuts], closer[cuts]
        last = np.maximum.accumulate(np.where(opens | closes, np.arange(len(cuts)), -1))
        kind = np.where(last >= 0, np.where(closes, OUTSIDE, np.where(data[cuts] == 0x5B, LIST, OBJECT))[last], self.kind)
        list_no = self.list_no + np.cumsum(opens)
        at = np.arange(len(cuts)) - last + np.where(last >= 0, 0, self.at)
        if self.want != "counts":
            yield from self.first(data[: cuts[0] + int(opens[0])], bool(closes[0]))
            yield from self.inner(data, cuts, opens, closes, kind, list_no, at)
        self.pending = [data[cuts[-1] + 1 :]] if self.want != "counts" else []
        self.place, self.head = self.place + len(cuts), False
        self.opened, self.changed = self.opened + int(opens.sum()), self.changed or last[-1] >= 0
        self.kind, self.list_no, self.at, self.fresh = int(kind[-1]), int(list_no[-1]), int(at[-1]), bool(opens[-1])

    def first(self, until: np.ndarray, closes: bool) -> Iterator[pa.RecordBatch]:
        """What ends at the first cut: the rest of an earlier split's item, or one that began in an earlier batch."""
        text = self.held(until)
        if self.head:
            if self.want == "ends":
                yield self.row(-1, False, text)
        elif self.kind == LIST and self.want == "items" and not (self.fresh and closes and not text.strip()):
            yield self.row(self.place, True, text)
        elif self.kind == OUTSIDE and self.want == "ends":
            yield self.row(self.place, True, text)

    def inner(self, data, cuts, opens, closes, kind, list_no, at) -> Iterator[pa.RecordBatch]:
        """What lies between two cuts of a batch."""
        if self.want == "ends":
            for k in np.flatnonzero(kind[:-1] == OUTSIDE):
                text = data[cuts[k] + 1 : cuts[k + 1] + 1].tobytes().decode("utf-8", "replace")
                yield self.rows([self.place + 1 + int(k)], [True], [OUTSIDE], [int(list_no[k])], [0], pa.array([text], pa.string()))
        elif len(cuts) > 1 and (kind[:-1] == LIST).any():
            keep = np.ones(cuts[-1] - cuts[0] - 1, bool)
            keep[cuts[1:-1] - cuts[0] - 1] = False
            text = strings(data[cuts[0] + 1 : cuts[-1]][keep], np.append(0, np.cumsum(np.diff(cuts) - 1)))
            blank = pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(text)), 0).to_numpy(zero_copy_only=False)
            chosen = (kind[:-1] == LIST) & ~(blank & opens[:-1] & closes[1:])  # not what an empty list holds
            pick = [c[:-1][chosen] for c in (kind, list_no, at)]
            places = (self.place + 1 + np.arange(len(cuts) - 1))[chosen]
            if chosen.any():
                yield self.rows(places, np.ones(len(places), bool), *pick, text.filter(pa.array(chosen)))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.want == "ends":
            yield self.row(-1 if self.head else self.place, not self.head, self.held(np.zeros(0, np.uint8)))
        elif self.want == "counts":
            yield self.rows([0], [self.changed], [self.kind], [self.opened], [self.at], pa.array([""], pa.string()))


def _cut(entries: dict[tuple[str, int], Entry], depth: int, want: str, end: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        for key, new, part in by_split(batches):
            if new:
                if split is not None:
                    yield from split.end()
                split = _Split(key, entries[key], depth, want)
            yield from split.add(_piece_bytes(part.column(4), end))
        if split is not None:
            yield from split.end()

    return run


def _numbered(entries: dict[tuple[str, int], Entry], counts: list) -> dict[tuple[str, int], Entry]:
    """Entries that also know which list, and which of its items, a split begins in."""
    known, file, kind, list_no, at = {}, None, OUTSIDE, 0, 0
    for r in sorted(counts, key=lambda r: (r["file"], r["split"])):
        if r["file"] != file:
            file, kind, list_no, at = r["file"], OUTSIDE, 0, 0
        entry = entries[r["file"], r["split"]]
        known[r["file"], r["split"]] = Entry(entry.inside, entry.depth, kind, list_no, at)
        kind, at = (r["kind"], r["at"]) if r["opens"] else (kind, at + r["at"])
        list_no += r["list_no"]
    return known


@dataclass(frozen=True)
class Member:
    """A member of an object document: a value, or the number of the list or object opened for it."""

    key: str
    value: object = None
    list_no: int = 0
    is_list: bool = False


def _members(outside: list[str]) -> list[Member]:
    """The members of a document from the texts outside of its lists and objects, in order."""
    found: dict[str, Member] = {}
    for number, text in enumerate(outside, 1):
        final = number == len(outside)
        text = text.removesuffix(",") if final else text  # the sign that the last piece was given
        body = text.strip("\ufeff \t\r\n").removeprefix("{").strip().removeprefix(",").strip()
        body = body.rstrip("} \t\r\n") if final else body + ("]" if body.endswith("[") else "}")
        pairs = json.loads("{" + body + "}", object_pairs_hook=list)
        for key, value in pairs[: None if final else -1]:
            found[key] = Member(key, value)
        if not final:
            found[pairs[-1][0]] = Member(pairs[-1][0], list_no=number, is_list=body.endswith("]"))
    return list(found.values())


def documents(spark: SparkSession, files: dict[str, list[str]]) -> DataFrame | None:
    """(file, split, place, text) of the records of JSON documents, stored; None if they are objects without a list.

    Runs a job for the first sign and one for each split's state, for objects one more that counts their lists, one for what lies outside of lists or
    over the ends of splits, and the one that stores the records. ValueError if the documents hold no records.
    """
    parts, end = pieces(spark, files)
    entries, sign = _entries(parts.mapInArrow(partial(_balance, end=end), _BALANCE_SQL).collect(), end)  # a row a split
    depth = 1 if sign == "[" else 2
    if depth == 2:
        entries = _numbered(entries, parts.mapInArrow(_cut(entries, 2, "counts", end), ITEMS).collect())  # a row a split
    ends = materialise(joined_fragments(parts.mapInArrow(_cut(entries, depth, "ends", end), ITEMS), ""), "json-ends")
    items = parts.mapInArrow(_cut(entries, depth, "items", end), ITEMS).drop("opens")
    items = items.unionByName(ends.filter((F.col("kind") == LIST) & ~_ends_empty(F.col("text"))))
    if depth == 2:
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("split", "place", "text"))), lambda x: x["text"])
        outside = ends.filter(F.col("kind") == OUTSIDE).groupBy("file").agg(in_order.alias("texts")).collect()  # keys and single values
        members = {r["file"]: _members(r["texts"]) for r in outside}
        if not any(m.is_list for own in members.values() for m in own):
            return None
        items = _chosen(spark, items, members)
    return materialise_compact(items.select("file", "split", "place", "text"), "json-items")


def _ends_empty(text):
    """An item cut off by the end of a split may be what an empty list holds."""
    return F.trim(text, F.lit(" \t\r\n")) == ""


def _chosen(spark: SparkSession, items: DataFrame, members: dict[str, list[Member]]) -> DataFrame:
    """The items of the list of records, or records made of the items of equal lists."""
    wanted, constants, lengths_differ = [], [], ValueError("lists differ in length")
    for file, own in members.items():
        lists = [m for m in own if m.is_list]
        by_key = {m.key: m for m in lists}
        named = [by_key[k] for k in fixed.RECORD_KEYS if k in by_key][:1]
        if not named and len(lists) < sum(m.list_no > 0 for m in own):
            raise ValueError("lists beside objects")
        order = [m.key for m in own]
        wanted += [(file, m.list_no, order.index(m.key), None if named else json.dumps(m.key)) for m in named or lists]
        if not named:
            constants += [(file, order.index(m.key), json.dumps(m.key) + ":" + json.dumps(m.value)) for m in own if not m.list_no]
    if len({w[3] is None for w in wanted}) > 1:
        raise ValueError("not all documents hold a list of records")
    lists = F.broadcast(spark.createDataFrame(wanted, "file string, list_no long, ord int, name string"))  # a row a list
    if wanted[0][3] is None:
        return items.join(lists.select("file", "list_no"), ["file", "list_no"])
    cells = items.join(lists, ["file", "list_no"])
    counts = {(r["file"], r["list_no"]): r["count"] for r in cells.groupBy("file", "list_no").count().collect()}  # a row a list
    for file in members:
        if len({counts.get((f, n), 0) for f, n, *_ in wanted if f == file}) > 1:
            raise lengths_differ
    cell = F.struct("ord", F.concat("name", F.lit(":"), "text").alias("s"))
    rows = cells.groupBy("file", "at").agg(F.collect_list(cell).alias("cells"))  # a cell a list
    fixed_cells = spark.createDataFrame(constants, "file string, ord int, s string").groupBy("file").agg(F.collect_list(F.struct("ord", "s")).alias("more"))
    rows = rows.join(F.broadcast(fixed_cells), "file", "left")
    whole = F.array_sort(F.concat("cells", F.coalesce("more", F.array().cast("array<struct<ord:int,s:string>>"))))
    text = F.concat(F.lit("{"), F.array_join(F.transform(whole, lambda c: c["s"]), ","), F.lit("}"))
    return rows.select("file", F.lit(0).cast("long").alias("split"), F.col("at").alias("place"), text.alias("text"))


def whole_documents(spark: SparkSession, files: dict[str, list[str]]) -> DataFrame:
    """(file, split, place, text) of documents that are one record each."""

    def read(encoding: str, paths: list[str]) -> DataFrame:
        found = spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True)
        text, zero = F.ltrim(decoded(F.col("value"), encoding), F.lit("\ufeff")), F.lit(0).cast("long")
        return found.select(F.col("_metadata.file_path").alias("file"), zero.alias("split"), zero.alias("place"), text.alias("text"))

    return reduce(DataFrame.union, [read(*group) for group in files.items()])
