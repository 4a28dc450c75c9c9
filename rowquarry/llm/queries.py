"""Registered queries of the corpus operators, one per operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowquarry.llm import (
    caps, langid, licenses, minhash, mixing, oracles, packing, passages, phrases, placement, quality, rules, spelling, texts, urls,
)
from rowquarry.session import materialise


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document, learned from the labels of the learning set."""
    docs = table(spark, sf, "documents")
    model = quality.fit(docs.filter(~texts.held_out()), table(spark, sf, "labels").filter(~texts.held_out()))
    scored = quality.score(docs.withColumn("held_out", texts.held_out()), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Component of every document under 85 % similarity of three-word shingles."""
    return minhash.near_duplicates(table(spark, sf, "documents"), words=3, percent=85)


def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from the learning set."""
    docs = table(spark, sf, "documents")
    model = langid.fit(docs.filter(~texts.held_out()))
    return langid.predict(docs.withColumn("held_out", texts.held_out()), model, ["doc_id", "held_out"])


def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes of every document."""
    sized = materialise(mixing.sizes(table(spark, sf, "documents"), ["doc_id", "source"]), "sizes")
    return mixing.mix(sized)


def op5_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdict for every document."""
    return rules.judge(table(spark, sf, "documents"), ["doc_id"])


def op6_passages(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that start earlier."""
    return passages.digests(table(spark, sf, "documents"))


def op7_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Licence families found in every document."""
    docs = table(spark, sf, "documents")
    return licenses.scan(docs, licenses.fit(docs), ["doc_id"])


def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf, "documents"))


def op9_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Links and component of every embedding under a cosine of 0.98."""
    return caps.near_vectors(table(spark, sf, "embeddings"))


def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Slot, shard and bytes of every document."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return placement.place(docs).select("doc_id", "slot", "shard", "n_bytes")


def blocked_keys(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(key): the pages of documents labelled toxic, and the hosts most of whose labelled pages are toxic or of low
    quality. A page's path bears its document's id."""
    host, path = urls.host_and_path(F.col("url"))
    placed = pages.select(host.alias("host"), path.alias("path"))
    number = F.regexp_extract("path", "/([0-9]+)", 1).try_cast("long")
    labelled = placed.withColumn("doc_id", number).join(labels.select("doc_id", "toxic", "quality"), "doc_id")
    toxic = labelled.filter("toxic = 1").select(F.concat("host", "path").alias("key"))
    bad = F.count_if((F.col("toxic") == 1) | (F.col("quality") == 0))
    hosts = labelled.groupBy("host").agg(bad.alias("bad"), F.count("*").alias("n")).filter("2 * bad > n")
    return toxic.union(hosts.select("host")).distinct()


def op11_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rule and verdict of every page's url; pages that no rule fits are held against the listed keys."""
    pages = table(spark, sf, "pages")
    return urls.judge(pages, blocked_keys(pages, table(spark, sf, "labels")))


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The best 2,000 phrases of two or three words of every language."""
    return phrases.collocations(table(spark, sf, "documents"))


def op13_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Every frequent word with its most frequent near word, if that is five times as frequent, and where such steps end."""
    return spelling.variants(table(spark, sf, "documents"))


def registered() -> dict:
    """Every query of this subpackage by name."""
    found = (
        op1_quality, op2_near_duplicates, op3_language, op4_mixing, op5_rules, op6_passages, op7_license_scan, op8_packing, op9_near_vectors,
        op10_sharding, op11_url_filter, op12_collocations, op13_spelling,
    )
    return {q.__name__: q for q in found}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return oracles.all_sql()
