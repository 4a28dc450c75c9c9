"""The written index: versions of segments, each with ``docs``, ``postings``, ``terms``, ``vectors`` and ``replaced`` as parquet.

A version is published by one small file, written last, that names its segments. A segment is written to a fresh folder
first, so a write that fails leaves nothing that is read, and can be tried again; readers of an older version are not
disturbed. Documents that are appended form a segment of their own. Ids that are written again replace the earlier ones.

Postings are dealt over files by document, a file being one row group of one task's size and sorted by term. So a search
reads the pages of the asked terms, and all postings of a document come in one task without a shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowquarry.operators import bm25, dense
from rowquarry.session import BROADCAST_MAX_BYTES, delete_path, list_names, side_by_side

FILE_BYTES = 16 << 20  # of text whose postings make one file
ROW_GROUP_BYTES = 1 << 30  # more than such a file holds, so that it is one row group and is never split
REPLACED_BYTES = 32  # that an id takes where it is sent to every task
SEGMENT = "ord int, segment string, n long, total long, n_replaced long"


@dataclass(frozen=True)
class RetrievalIndex:
    docs: DataFrame  # doc_id, text and whatever else the chunks carry
    keyword: bm25.KeywordIndex
    vectors: DataFrame


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", embed: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Publish a version that holds these documents alone; returns its number. ``docs`` is evaluated once."""
    return _publish(docs.sparkSession, path, [], docs, id_col, embed)


def append_index(docs: DataFrame, path: str, id_col: str = "doc_id", embed: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Publish a version with these documents besides those of the newest one; the same ids replace theirs."""
    spark = docs.sparkSession
    return _publish(spark, path, _segments(spark, path, _versions(spark, path)[-1]), docs, id_col, embed)


def _versions(spark: SparkSession, path: str) -> list[int]:
    names = list_names(spark, f"{path}/versions")
    return sorted(int(n) for n in names if n.isdigit() and "_SUCCESS" in list_names(spark, f"{path}/versions/{n}"))


def _segments(spark: SparkSession, path: str, version: int) -> list:
    return spark.read.schema(SEGMENT).json(f"{path}/versions/{version:06d}").orderBy("ord").collect()  # a row a segment


def _publish(spark: SparkSession, path: str, earlier: list, docs: DataFrame, id_col: str, embed) -> int:
    name = uuid.uuid4().hex
    folder = f"{path}/segments/{name}"
    docs.withColumnRenamed(id_col, "doc_id").write.parquet(f"{folder}/docs")
    stored = spark.read.parquet(f"{folder}/docs")
    size = stored.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()

    def write_postings() -> None:
        post = bm25.postings(bm25.tokenised(stored, partitions=max(spark.sparkContext.defaultParallelism, -(-size["bytes"] // FILE_BYTES))))
        placed = post.select("term", "doc_id", "tf", "dl").sortWithinPartitions("term", "doc_id")
        placed.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{folder}/postings")

    def write_replaced() -> None:
        ids = [spark.read.parquet(f"{path}/segments/{s['segment']}/docs").select("doc_id") for s in earlier]
        known = reduce(DataFrame.union, ids) if ids else stored.select("doc_id").limit(0)
        stored.select("doc_id").join(known, "doc_id", "left_semi").distinct().write.parquet(f"{folder}/replaced")

    side_by_side([write_postings, write_replaced])
    postings = spark.read.parquet(f"{folder}/postings")

    def write_terms() -> None:
        postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.parquet(f"{folder}/terms")

    def write_vectors() -> None:
        vectors = embed(stored) if embed is not None else dense.embed_files(stored, postings.select("*", F.col("_metadata.file_path").alias("file")))
        vectors.select("doc_id", "vec").write.parquet(f"{folder}/vectors")

    side_by_side([write_terms, write_vectors])
    total = postings.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    n_replaced = spark.read.parquet(f"{folder}/replaced").count()
    rows = [*[(i, s["segment"], s["n"], s["total"], s["n_replaced"]) for i, s in enumerate(earlier)], (len(earlier), name, size["n"], total, n_replaced)]
    number = max([0, *_versions(spark, path)]) + 1
    spark.createDataFrame(rows, SEGMENT).coalesce(1).write.json(f"{path}/versions/{number:06d}")
    return number


def open_index(spark: SparkSession, path: str, version: int | None = None) -> RetrievalIndex:
    """A written index, by default its newest version; nothing is scanned until it is asked. Ids that were replaced are sent
    to every task while they fit, so that the others' postings are searched where they lie; else both are shuffled."""
    found = _versions(spark, path)
    if version is None and not found:
        raise ValueError(f"no index at {path}")
    segments = _segments(spark, path, found[-1] if version is None else version)
    gone = [(s["ord"], spark.read.parquet(f"{path}/segments/{s['segment']}/replaced")) for s in segments if s["n_replaced"]]
    few = sum(s["n_replaced"] for s in segments) * REPLACED_BYTES <= BROADCAST_MAX_BYTES

    def live(table: str) -> DataFrame:
        parts = []
        for s in segments:
            part = spark.read.parquet(f"{path}/segments/{s['segment']}/{table}")
            if table == "postings":
                part = part.select("*", F.col("_metadata.file_path").alias("file"))
            later = [ids for ord_, ids in gone if ord_ > s["ord"]]
            if later:
                ids = reduce(DataFrame.union, later).distinct()
                part = part.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")
            parts.append(part)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    postings, docs = live("postings"), live("docs")
    if gone:
        stats, terms = bm25.totals(docs, postings), None
    else:
        n, total = sum(s["n"] for s in segments), sum(s["total"] for s in segments)
        stats = spark.createDataFrame([(n, total, total / max(n, 1))], "n long, total long, avgdl double")
        parts = [spark.read.parquet(f"{path}/segments/{s['segment']}/terms") for s in segments]
        counted = reduce(DataFrame.union, parts).groupBy("term").agg(F.sum("df").alias("df")) if len(parts) > 1 else parts[0]
        terms = counted.select("term", "df", bm25.inverse_frequency(F.lit(n), F.col("df")).alias("idf"))
    return RetrievalIndex(docs, bm25.KeywordIndex(postings, stats, terms, by_file=not gone or few), live("vectors"))


def prune_versions(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all but the newest versions, and the segments that none of these names. For when no search or write runs."""
    versions = _versions(spark, path)
    kept = versions[-keep:]
    named = {s["segment"] for v in kept for s in _segments(spark, path, v)}
    for folder in list_names(spark, f"{path}/versions"):
        if not folder.isdigit() or int(folder) not in kept:
            delete_path(spark, f"{path}/versions/{folder}")
    for folder in list_names(spark, f"{path}/segments"):
        if folder not in named:
            delete_path(spark, f"{path}/segments/{folder}")
