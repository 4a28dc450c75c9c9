"""From raw documents to packed training sequences: language, near copies, repeated passages, mix, packing."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowquarry.llm import langid, minhash, mixing, packing, passages
from rowquarry.session import ship_package, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters, or between two languages, go."""
    ship_package(spark)
    return langid.recognised(docs, langid.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that is linked by 80 % of its five-word shingles."""
    ship_package(spark)
    return minhash.keep_one(docs, words=5, percent=80)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 100 bytes that start earlier; n_chars follows the text."""
    ship_package(spark)
    left = passages.remove_repeats(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of 150 % of all words takes them."""
    ship_package(spark)
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("passages", remove_passages),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # learned models, minima and packing are not SQL; the tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Every stage is written to the shared folder and read again by the next; what a stage stores
    on its way is deleted when it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(spark, name, partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
