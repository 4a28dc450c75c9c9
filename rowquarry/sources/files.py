"""Delimited and JSON files as cleaned, numbered tables, with a manifest of what was found.

A table is one file, or one folder of part files named like a file (``orders.csv/part-0…``).
"""

from __future__ import annotations

import csv
import math
import re
from dataclasses import dataclass, field
from functools import partial, reduce
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowquarry.functions import fixed
from rowquarry.operators.clean import clean_numbered, normal_name, unique_names
from rowquarry.operators.rows import NumberedTable
from rowquarry.session import side_by_side
from rowquarry.sources import json_documents, json_records, quoted_lines
from rowquarry.sources.json_records import FILE_ORDER, flatten
from rowquarry.sources.splits import CHARSETS, chunks

DELIMITED = (".csv", ".tsv", ".txt")
JSON = (".json", ".jsonl")
PARQUET = (".parquet",)

MANIFEST_SCHEMA = (
    "table string, path string, file_type string, encoding string, separator string, "
    "n_rows long, n_cols int, errors array<string>"
)

# Schema inference reports a bad record as a plain JVM error.
SPARK_ERRORS = (PySparkException, Py4JJavaError)

# Tables of together at most so many bytes are cleaned side by side, larger ones one after the other: what is shuffled for
# them lies on disk at one time.
SIDE_BY_SIDE_BYTES = 512 * 1024 * 1024


@dataclass(frozen=True)
class Source:
    """One table's files."""

    path: str
    first_file: str
    suffix: str
    n_bytes: int = 0

    @property
    def table(self) -> str:
        return table_name(self.path)


@dataclass
class Scan:
    source: Source
    file_type: str
    rows: DataFrame | None = None
    encoding: str | None = None
    separator: str | None = None
    errors: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class LoadedTables:
    tables: dict[str, NumberedTable]
    manifest: DataFrame


def table_name(path: str) -> str:
    """File stem, lower case, spaces as ``_``, at most 40 characters."""
    stem = re.sub(r"\.[^.]*$", "", path.rstrip("/").rsplit("/", 1)[-1])
    return stem.lower().replace(" ", "_")[: fixed.TABLE_NAME_LENGTH]


def _suffix(path: str) -> str:
    match = re.search(r"\.[^./]+$", path.rstrip("/"))
    return match.group(0).lower() if match else ""


def list_sources(spark: SparkSession, path: str) -> list[Source]:
    """The tables under a folder, or the one at a file path, by name. Reads no file content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    root = unquote(urlparse(path).path).rstrip("/")
    local = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    inside = F.when(local.startswith(root), F.substring(local, F.lit(len(root) + 1), F.length(local))).otherwise(local)
    known = _suffix(root) in DELIMITED + JSON + PARQUET  # a folder of parts that is one table
    entry = F.lit("") if known else F.regexp_extract(inside, r"^/([^/]+)", 1)
    listed = files.groupBy(entry.alias("entry")).agg(F.min("path").alias("first"), F.sum("length").alias("n_bytes")).orderBy("entry").collect()  # one row per table

    def kind(name: str, first: str) -> str:
        """A known suffix of the table's name, or else that of its first file: folder names may hold dots."""
        own = _suffix(name)
        return own if own in DELIMITED + JSON + PARQUET or unquote(first).endswith(f"/{name.rsplit('/', 1)[-1]}") else _suffix(first)

    return [Source(f"{path.rstrip('/')}/{r['entry']}".rstrip("/"), r["first"], kind(r["entry"] or root, r["first"]), r["n_bytes"]) for r in listed]


# --- encoding and separator ---------------------------------------------------------------------


def file_encodings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, file, encoding)`` of every file under each table's path.

    'utf-16-le' or 'utf-16-be' if a file begins with that byte order mark; 'utf-8' if every line is valid; else 'cp1252' if
    control codes of Latin-1 occur and all of them stand for letters there; else 'latin-1'. The text source keeps raw bytes
    and splits files, so the check runs line by line over all splits and only a few flags per file are shuffled.
    """
    value = F.col("value")
    bytes_of = F.decode(value.cast("binary"), "ISO-8859-1")
    valid = F.is_valid_utf8(value)
    start = F.when(F.col("_metadata.file_block_start") == 0, F.hex(F.substring(value.cast("binary"), 1, 2)))
    lines = spark.read.text(paths, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"),
        valid.alias("valid"),
        F.coalesce(~valid & bytes_of.rlike(f"[{fixed.CP1252_CODES}]"), F.lit(False)).alias("letters"),
        F.coalesce(~valid & bytes_of.rlike("[\\x81\\x8d\\x8f\\x90\\x9d]"), F.lit(False)).alias("none"),
        F.coalesce(start == "FFFE", F.lit(False)).alias("low"),
        F.coalesce(start == "FEFF", F.lit(False)).alias("high"),
    )
    flags = [F.bool_and("valid").alias("valid"), *[F.bool_or(c).alias(c) for c in ("letters", "none", "low", "high")]]
    named = F.when(F.col("low"), "utf-16-le").when(F.col("high"), "utf-16-be").when(F.col("valid"), "utf-8")
    named = named.when(F.col("letters") & ~F.col("none"), "cp1252").otherwise("latin-1")
    # The metadata path is percent-encoded; a plus sign in it is a plus sign.
    plain = F.url_decode(F.replace(F.col("file"), F.lit("+"), F.lit("%2B")))
    owner = F.coalesce(*[F.when(_under(plain, p), F.lit(p)) for p in paths])
    return lines.groupBy("file").agg(*flags).select(owner.alias("path"), "file", named.alias("encoding"))


def encodings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, encoding)`` of each table; of parts in several encodings, the one that comes last in this order: utf-8,
    cp1252, latin-1, utf-16."""
    rank = F.array_position(F.array(*[F.lit(e) for e in ENCODINGS]), F.col("encoding"))
    return file_encodings(spark, paths).groupBy("path").agg(F.max_by("encoding", rank).alias("encoding"))


ENCODINGS = ["utf-8", "cp1252", "latin-1", "utf-16-be", "utf-16-le"]


def _under(file: Column, path: str) -> Column:
    """Whether a file URI is this path or lies under it."""
    local = unquote(urlparse(path).path)
    return file.endswith(local) | file.contains(local.rstrip("/") + "/")


def first_lines(spark: SparkSession, files: dict[str, str], encodings: dict[str, str] | None = None) -> DataFrame:
    """``(path, line)``: the first 20 lines of each table's first file, reduced to their separators and quotes: only these and
    a sign for any other text decide. Lines whose quotes show the separator are cut into records, without what lies in
    quotes. Each file's lines are read by a job that stops in the first split.
    """
    others = "[^" + "".join(f"\\x{ord(c):02x}" for c in [*fixed.SEPARATORS, '"']) + "]+"

    def sampled(path: str, first: str) -> list[tuple[str, str]]:
        encoding = (encodings or {}).get(path, "utf-8")
        text = F.ltrim(F.rtrim("text", F.lit("\r")), F.lit("\ufeff"))
        rows = chunks(spark, {encoding: [first]}, "\n").select(F.regexp_replace(text, others, "x").alias("line")).head(fixed.SNIFF_LINES)
        return [(path, line) for line in quoted_sample([r["line"] for r in rows])]

    found = side_by_side([partial(sampled, *item) for item in files.items()])
    return spark.createDataFrame([row for rows in found for row in rows], "path string, line string")


def _quoted_fields(lines: list[str], separator: str) -> tuple[list[int], bool] | None:
    """How many fields each whole record of some first lines has, and whether one goes on over a line break; None if no field
    is in quotes, or a closing quote is not followed by the separator or the end of its line."""
    counts, n, state, blank = [], 1, "start", False
    quotes = breaks = False
    for line in lines:
        if state != "quoted":
            n, state, blank = 1, "start", not line.strip(" ")
        for c in line:
            if state == "quoted":
                state = "closed" if c == '"' else "quoted"
            elif c == separator:
                n, state = n + 1, "start"
            elif state == "closed":
                if c != '"':
                    return None
                state = "quoted"
            elif c == '"' and state == "start":
                state, quotes = "quoted", True
            else:
                state = "plain"
        if state == "quoted":
            breaks = True
        elif not blank:
            counts.append(n)
    if not quotes or not counts or (state == "quoted" and n > max(counts)):
        return None
    return counts, breaks


def quoted_sample(lines: list[str]) -> list[str]:
    """The records among some first lines, reduced to the separator that their quotes show; else the lines as they are.

    Fields in quotes must begin and end at the separator, and either one goes on over a line break, so that lines are no
    records, or all records have equally many fields. So prose in quotes does not decide by its spaces and commas.
    """
    best, best_score = lines, 0.0
    for separator in fixed.SEPARATORS:
        counts, breaks = _quoted_fields(lines, separator) or ([], False)
        usual = max(sorted(set(counts)), key=counts.count, default=1)
        share = counts.count(usual) / max(1, len(counts))
        score = share * math.log1p(sum(counts) - len(counts))
        if usual > 1 and (breaks or share == 1) and score > best_score:
            best, best_score = [separator.join("x" * n) for n in counts], score
    return best


def separators(lines: DataFrame) -> DataFrame:
    """``(path, separator)`` from sample lines ``(path, line_no, line)``.

    A separator scores the share of lines with the most usual field count, times
    ``log1p`` of its occurrences; lines are cut without regard to quotes. It needs more than
    one field. The first of the best wins; a comma if none qualifies.
    """
    options = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("separator")) for i, s in enumerate(fixed.SEPARATORS)])
    seen = F.length("line") - F.length(F.replace(F.col("line"), F.col("separator"), F.lit("")))
    fields = (
        lines.select("path", "line", F.inline(options))
        .withColumn("hits", seen)
        .withColumn("n_fields", F.when(F.trim("line") != "", F.col("hits") + 1))
    )
    counted = fields.groupBy("path", "ord", "separator", "n_fields").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("hits").alias("hits")
    )
    scored = (
        counted.groupBy("path", "ord", "separator")
        .agg(
            F.sum("hits").alias("hits"),
            F.sum(F.when(F.col("n_fields").isNotNull(), F.col("n_lines"))).alias("lines"),
            F.max(F.when(F.col("n_fields").isNotNull(), F.struct("n_lines", (-F.col("n_fields")).alias("neg")))).alias("mode"),
        )
        .withColumn("usual", -F.col("mode.neg"))
        .withColumn("score", F.col("mode.n_lines") / F.col("lines") * F.log1p("hits"))
    )
    fits = (F.col("hits") > 0) & (F.col("usual") > 1)
    best = F.max_by(F.when(fits, F.col("separator")), F.when(fits, F.struct("score", (-F.col("ord")).alias("o"))))
    return scored.groupBy("path").agg(F.coalesce(best, F.lit(",")).alias("separator"))


# --- scans -----------------------------------------------------------------------------------------


def _file_order() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"),
    ).alias(FILE_ORDER)


def _head_reader(spark: SparkSession, file: str, encoding: str):
    """A reader of a file's lines on the driver, through the file system that Spark uses."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    charset = CHARSETS.get(encoding, "UTF-8" if encoding == "utf-8" else "ISO-8859-1")
    return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, charset))


def header(spark: SparkSession, file: str, separator: str, encoding: str) -> tuple[str, ...] | None:
    """The titles of one delimited file: its first record that is not blank, which may hold quoted line breaks."""
    reader = _head_reader(spark, file, encoding)
    try:
        lines: list[str] = []
        while (line := reader.readLine()) is not None:
            line = line.removeprefix("\ufeff") if not lines else line
            if encoding == "cp1252":
                line = line.translate(str.maketrans(fixed.CP1252_CODES, fixed.CP1252_LETTERS))
            if lines or line.strip():
                lines.append(line)
                record = next(csv.reader(["\n".join(lines)], delimiter=separator, strict=False), [])
                if not _open_quote("\n".join(lines), separator):
                    return tuple(record)
        return None
    finally:
        reader.close()


def _open_quote(text: str, separator: str) -> bool:
    """Whether a record goes on after this text: a quote opens a field only at its start, and two inside stand for one."""
    state = "start"
    for c in text:
        if state == "quoted":
            state = "closed" if c == '"' else "quoted"
        elif c == '"' and state in ("start", "closed"):
            state = "quoted"
        else:
            state = "start" if c == separator else "plain"
    return state == "quoted"


def _headers(spark: SparkSession, files: dict[str, list[str]], separator: str) -> dict[tuple[str, ...], dict[str, list[str]]]:
    """The table's files by their titles and encoding, in file order. The driver reads one record of each file."""
    listed = [(f, e) for e, paths in files.items() for f in spark.read.option("recursiveFileLookup", "true").text(paths).inputFiles()]
    listed.sort()
    found: dict[tuple[str, ...], dict[str, list[str]]] = {}
    for (file, encoding), titles in zip(listed, side_by_side([partial(header, spark, f, separator, e) for f, e in listed])):
        if titles:
            found.setdefault(titles, {}).setdefault(encoding, []).append(unquote(file))
    return found


def scan_delimited(
    spark: SparkSession,
    source: Source,
    separator: str,
    files: dict[str, list[str]] | None = None,
    na_values: list[str] | None = None,
    breaks: bool | None = None,
) -> DataFrame:
    """All columns as text, named by the header, with a ``__file_order`` column.

    Short lines are padded with null and lines with a surplus field are dropped. ``na_values`` become null. ``files`` are
    the table's files by encoding (None: all in UTF-8). Part files with unlike headers are read by their own and united by
    name. Line breaks inside quotes may lie in any split; ``breaks`` says whether there are any (None: a job finds out).
    """
    files = files or {"utf-8": [source.path]}
    groups = _headers(spark, files, separator)
    if not groups:
        raise ValueError("no columns to parse")
    if breaks is None:
        breaks = quoted_lines.has_breaks(spark, files, separator)
    missing = list(fixed.NA_VALUES if na_values is None else na_values)
    scans = []
    for titles, own in groups.items():
        own = own if len(groups) > 1 else files
        columns = [f"c{i}" for i in range(len(titles))]
        reader = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
        schema = ", ".join(f"{c} string" for c in [*columns, "extra"])
        (encoding, paths), *others = own.items()
        if breaks or others or encoding not in ("utf-8", "latin-1"):
            found = quoted_lines.records(spark, own, separator, breaks)
            raw = found.select(F.from_csv("text", schema, reader).alias("r"), F.struct("file", "split", "place").alias(FILE_ORDER)).select("r.*", FILE_ORDER)
        else:
            reader["encoding"] = "ISO-8859-1" if encoding == "latin-1" else "UTF-8"
            lines = spark.read.schema(schema).csv(paths, header=True, recursiveFileLookup=True, **reader)
            raw = lines.select(*columns, "extra", _file_order())
        named = [(c, t) for c, t in zip(columns, titles) if t.strip() and not t.startswith("Unnamed")]
        names = unique_names([normal_name(t) for _, t in named])
        cells = [F.when(~F.col(c).isin(missing), F.col(c)).alias(name) for (c, _), name in zip(named, names)]
        scans.append(raw.filter(F.col("extra").isNull()).select(*cells, FILE_ORDER))
    united = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), scans)
    return united.select(*[c for c in united.columns if c != FILE_ORDER], FILE_ORDER)


def scan_json(spark: SparkSession, source: Source, files: dict[str, list[str]] | None = None) -> DataFrame:
    """JSON lines, an array of objects, an object holding records, or an object of equal lists.

    All are read split by split; lines must all parse. Only an object that is one record is read whole. ``files`` are the
    table's files by encoding (None: all in UTF-8).
    """
    files = files or {"utf-8": [source.path]}
    lines = chunks(spark, files, "\n").withColumn("text", F.btrim("text", F.lit(" \t\r\ufeff"))).filter("text <> ''")
    # Only the start of a line and whether it is a whole object reach the driver.
    start = F.col("text").startswith("{")
    head = lines.select(start.alias("start"), (start & F.json_object_keys("text").isNotNull()).alias("record")).head(2)
    if not head:
        raise ValueError("empty file")
    parts = urlparse(source.path.rstrip("/")).path != urlparse(source.first_file).path
    if (len(head) > 1 or parts) and head[0]["record"]:
        # Several records cannot be one document either, so a bad line is an error of the file.
        return json_records.table(lines.select("file", "split", F.monotonically_increasing_id().alias("place"), "text"))
    records = json_documents.documents(spark, files)
    return json_records.table(json_documents.whole_documents(spark, files) if records is None else records)


def scan_tables(spark: SparkSession, path: str) -> list[Scan]:
    """Every table under ``path`` as an unclean scan. Problems are recorded, not raised.

    Runs the listing, encoding and separator jobs, once for all tables.
    """
    sources = list_sources(spark, path)
    texts = [s.path for s in sources if s.suffix in DELIMITED + JSON]
    found: dict[str, dict[str, list[str]]] = {p: {} for p in texts}
    for r in file_encodings(spark, texts).orderBy("file").collect() if texts else []:  # one row per file
        found[r["path"]].setdefault(r["encoding"], []).append(unquote(r["file"]))
    found = {p: {next(iter(own)): [p]} if len(own) == 1 else own for p, own in found.items()}
    sniffed = {s.path: s.first_file for s in sources if s.suffix in (".csv", ".txt") and found[s.path]}
    firsts = {p: next((e for e, paths in found[p].items() if unquote(f) in paths), next(iter(found[p]))) for p, f in sniffed.items()}
    chosen = {r["path"]: r["separator"] for r in separators(first_lines(spark, sniffed, firsts)).collect()} if sniffed else {}
    return side_by_side([partial(_scan, spark, s, found.get(s.path) or {"utf-8": [s.path]}, chosen.get(s.path)) for s in sources])


def _scan(spark: SparkSession, source: Source, files: dict[str, list[str]], separator: str | None) -> Scan:
    encoding = max(files, key=ENCODINGS.index)
    if source.suffix in DELIMITED:
        scan = Scan(source, "CSV", encoding=encoding, separator="\t" if source.suffix == ".tsv" else separator or ",")
        try:
            scan.rows = scan_delimited(spark, source, scan.separator, files)
        except (*SPARK_ERRORS, ValueError) as problem:
            scan.errors.append(f"CSV parse error: {_first_line(problem)}")
    elif source.suffix in JSON:
        scan = Scan(source, "JSON", encoding=encoding)
        try:
            scan.rows = scan_json(spark, source, files)
        except (*SPARK_ERRORS, ValueError) as problem:
            scan.errors.append(f"Could not parse JSON into tabular format. {_first_line(problem)}")
    elif source.suffix in PARQUET:
        scan = Scan(source, "Parquet", encoding="binary")
        try:
            rows = spark.read.option("recursiveFileLookup", "true").parquet(source.path)
            scan.rows = flatten(rows.select("*", _file_order()), hidden=1)
        except (*SPARK_ERRORS, ValueError) as problem:
            scan.errors.append(f"Parquet parse error: {_first_line(problem)}")
    else:
        scan = Scan(source, "", errors=[f"Unsupported file type: {source.suffix}"])
    return scan


def _first_line(problem: Exception) -> str:
    text = problem.java_exception.getMessage() if isinstance(problem, Py4JJavaError) else str(problem)
    return text.strip().split("\n")[0]


def load_tables(spark: SparkSession, path: str) -> LoadedTables:
    """Scan, clean and number every table under ``path``. Runs jobs per table.

    A table with a header and no rows is kept; one that fails is recorded in the manifest and the rest go on.
    """
    scans = scan_tables(spark, path)
    cleaned = [table for group in _groups(scans) for table in side_by_side([partial(_cleaned, scan) for scan in group])]
    tables: dict[str, NumberedTable] = {}
    rows = []
    for scan, table in zip(scans, cleaned):
        name = scan.source.table
        if table is not None and table.columns:
            name = unique_names([*tables, name])[-1]
            tables[name] = table
        shape = (table.n_rows, len(table.columns)) if table is not None else (None, None)
        encoding = "utf-16" if scan.encoding in CHARSETS else scan.encoding
        rows.append((name, scan.source.path, scan.file_type, encoding, scan.separator, *shape, scan.errors))
    return LoadedTables(tables, spark.createDataFrame(rows, MANIFEST_SCHEMA))


def _groups(scans: list[Scan]) -> list[list[Scan]]:
    """Scans in their order, in groups of at most ``SIDE_BY_SIDE_BYTES`` or of one."""
    groups: list[list[Scan]] = []
    left = 0
    for scan in scans:
        if not groups or scan.source.n_bytes > left:
            groups.append([])
            left = SIDE_BY_SIDE_BYTES
        groups[-1].append(scan)
        left -= scan.source.n_bytes
    return groups


def _cleaned(scan: Scan) -> NumberedTable | None:
    if scan.rows is None:
        return None
    try:
        return clean_numbered(scan.rows, [FILE_ORDER], hidden=(FILE_ORDER,))
    except SPARK_ERRORS as problem:
        scan.errors.append(f"{scan.file_type} parse error: {_first_line(problem)}")
        return None
