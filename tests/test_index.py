"""The written index: versions, appended segments, one evaluation of the source, and searches that move little."""

import io
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowquarry.functions.kernels import BestWeighted
from rowquarry.operators import bm25, dense
from rowquarry.operators.sieve import sieve
from rowquarry.plans import retrieve
from rowquarry.session import list_names, materialise
from rowquarry.sources import index_io


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue().split("===== Subqueries")[0]


def made(spark, low, high, extra=""):
    text = F.concat(F.format_string("word%d common text number%d ", F.col("id") % 50, F.col("id") % 7), F.lit(extra))
    return spark.range(low, high).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("document").alias("chunk_type"), F.lit("t").alias("table"))


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(i, f"word{i} number{i % 7} text fresh") for i in range(20)]
    return spark.createDataFrame(rows, "query_id long, text string")


def best(index, asked, k=10):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in bm25.search(index.keyword, asked, k).collect())


def test_the_source_is_evaluated_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    docs = made(spark, 0, 300)
    index_io.write_index(docs.mapInPandas(count, docs.schema), str(tmp_path / "i"))
    assert seen.value == 300


def test_appending_equals_writing_all(spark, tmp_path, asked):
    grown, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    assert index_io.write_index(made(spark, 0, 200), grown) == 1
    assert index_io.append_index(made(spark, 200, 320), grown) == 2
    assert index_io.append_index(made(spark, 100, 150, "fresh words").unionByName(made(spark, 320, 330)), grown) == 3
    everything = made(spark, 0, 100).unionByName(made(spark, 100, 150, "fresh words")).unionByName(made(spark, 150, 330))
    index_io.write_index(everything, whole)
    now, then, at_once = index_io.open_index(spark, grown), index_io.open_index(spark, grown, version=2), index_io.open_index(spark, whole)
    assert best(now, asked) == best(at_once, asked)
    assert best(then, asked) == best(index_io.open_index(spark, grown, version=2), asked) != best(now, asked)
    assert now.docs.count() == 330 and now.vectors.count() == 330
    rows = lambda i: {r["query_id"]: r["context"] for r in retrieve.contexts(i, asked).collect()}
    assert rows(now) == rows(at_once)
    index_io.prune_versions(spark, grown)
    assert list_names(spark, f"{grown}/versions") == ["000003"] and len(list_names(spark, f"{grown}/segments")) == 3
    assert best(index_io.open_index(spark, grown), asked) == best(at_once, asked)


def test_a_write_that_fails_disturbs_nothing(spark, tmp_path, asked):
    path = str(tmp_path / "i")
    with pytest.raises(ValueError):
        index_io.open_index(spark, path)
    index_io.write_index(made(spark, 0, 60), path)
    before = best(index_io.open_index(spark, path), asked)

    def fail(batches):
        raise RuntimeError("lost")
        yield

    docs = made(spark, 60, 90)
    with pytest.raises(Exception, match="lost"):
        index_io.append_index(docs.mapInPandas(fail, docs.schema), path)
    assert best(index_io.open_index(spark, path), asked) == before
    assert index_io.append_index(docs, path) == 2
    assert index_io.open_index(spark, path).docs.count() == 90
    index_io.prune_versions(spark, path)
    assert len(list_names(spark, f"{path}/segments")) == 2


def test_a_written_index_is_searched_where_it_lies(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(index_io, "FILE_BYTES", 2000)
    path = str(tmp_path / "i")
    docs = made(spark, 0, 500)
    index_io.write_index(docs, path)
    index = index_io.open_index(spark, path)
    files = index.keyword.postings.select("doc_id", "file").distinct().groupBy("doc_id").count().filter("count > 1")
    assert files.count() == 0 and index.keyword.postings.select("file").distinct().count() > 5
    text = plan(bm25.search(index.keyword, asked))
    assert "hashpartitioning(doc_id" not in text and text.count("hashpartitioning(") == 1
    want = best(type(index)(index.docs, bm25.index_documents(docs), index.vectors), asked)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "700"):  # files are never split: each is one row group
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert best(index_io.open_index(spark, path), asked) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_replaced_ids_move_no_postings(spark, tmp_path, asked, monkeypatch):
    path = str(tmp_path / "i")
    index_io.write_index(made(spark, 0, 200), path)
    index_io.append_index(made(spark, 50, 90, "fresh"), path)
    index_io.append_index(made(spark, 80, 120, "fresh words"), path)
    index = index_io.open_index(spark, path)
    assert index.keyword.by_file
    monkeypatch.setattr(index_io, "BROADCAST_MAX_BYTES", 0)
    many = index_io.open_index(spark, path)
    assert not many.keyword.by_file and best(many, asked) == best(index, asked)


def test_bounds_leave_out_only_what_cannot_enter():
    rng = np.random.default_rng(3)
    n_terms, n_questions, k = 12, 9, 4
    cuts = np.append(0, np.cumsum(rng.integers(0, 4, n_terms)))
    owner, weight = rng.integers(0, n_questions, cuts[-1]), rng.integers(1, 5, cuts[-1]) / 2
    plain, bounded = (BestWeighted(n_questions, cuts, owner, weight, k) for _ in range(2))
    for block in range(40):
        sizes = rng.integers(0, 6, 8)
        offsets = np.append(0, np.cumsum(sizes))
        terms = np.concatenate([rng.choice(n_terms, s, replace=False) for s in sizes])
        parts = rng.integers(1, 9, offsets[-1]) / 4
        plain.add(np.arange(8) + 8 * (40 - block), offsets, terms, parts)
        bounded.add(np.arange(8) + 8 * (40 - block), offsets, terms, parts, bounded=True)
    for a, b in ((plain.best.owner, bounded.best.owner), (plain.best.ids, bounded.best.ids), (plain.best.scores, bounded.best.scores)):
        assert a.tolist() == b.tolist()


def test_only_picked_text_moves(spark):
    docs = materialise(made(spark, 0, 4000), "gather-docs")
    picks = spark.range(0, 4000, 100).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("query_id"), F.lit(1).alias("rank"))
    ids = materialise(picks.select("doc_id"), "gather-ids")
    passed = docs.filter(sieve(ids, "doc_id", 40))
    assert passed.join(picks, "doc_id").count() == 40 and passed.count() < 200
    assert docs.filter(sieve(ids, "doc_id", 40, max_bits=64)).join(picks, "doc_id").count() == 40
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = (retrieve.gather(picks, docs, few=f) for f in (True, False))
        assert sorted(few.select("doc_id", "text").collect()) == sorted(many.select("doc_id", "text").collect())
        text = plan(many)
        assert "getbit(" in text and text.index("getbit(") < text.rindex("Exchange")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_vectors_come_from_files_without_shuffling_postings(spark, tmp_path):
    words = F.when(F.col("id") % 9 == 0, "?!").when(F.col("id") % 9 == 1, None).otherwise(F.concat_ws(" ", F.lit("Größe common common"), F.col("id"), F.col("id") % 5))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), words.alias("text"))
    index_io.write_index(docs, str(tmp_path))
    index = index_io.open_index(spark, str(tmp_path))
    post = index.keyword.postings
    assert post.select("file").distinct().count() > 1

    def vectors(df):
        return {r["doc_id"]: r["vec"] for r in df.collect()}

    expected = vectors(dense.embed_postings(docs, post))
    found = dense.embed_files(docs, post)
    assert len(expected) == 300 and vectors(found) == expected == vectors(index.vectors)
    assert plan(found).count("Exchange (") < plan(dense.embed_postings(docs, post)).count("Exchange (")
    few = dense.embed_files(docs, post.filter("doc_id < 50"), 4)
    assert vectors(few) == vectors(dense.embed_postings(docs, post.filter("doc_id < 50"), 4))
