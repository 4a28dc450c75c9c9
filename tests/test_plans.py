"""The shape of the plans that matter at scale."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from rowquarry.operators import bm25, dense
from rowquarry.plans import retrieve
from rowquarry.session import materialise
from rowquarry.sources import index_io


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue().split("===== Subqueries")[0]


@pytest.fixture(scope="module")
def docs(spark):
    made = spark.range(500).select(F.col("id").alias("doc_id"), F.format_string("word%d common text", F.col("id") % 50).alias("text"))
    return materialise(made.withColumns({"chunk_type": F.lit("row_window"), "table": F.lit("t")}), "plan-docs")


@pytest.fixture(scope="module")
def asked(spark, docs):
    return materialise(docs.filter("doc_id < 20").select(F.col("doc_id").alias("query_id"), "text"), "plan-asked")


def test_bm25_scores_without_shuffling_pairs(docs, asked):
    text = plan(bm25.search(bm25.index_documents(docs), asked))
    assert "hashpartitioning(query_id" in text
    assert not any("hashpartitioning(query_id" in line and "doc_id" in line for line in text.splitlines())
    assert text.count("WindowGroupLimit") >= 2 and "NestedLoop" not in text and "Cartesian" not in text


def test_bm25_in_many_blocks_only_ranks_what_each_pass_kept(docs, asked):
    text = plan(bm25.search(bm25.index_documents(docs), asked, k=3, max_block_bytes=1000))
    assert text.count("Exchange (") == 1 and "Generate" not in text


def test_vector_search_streams_documents_unshuffled(docs, asked):
    vectors = materialise(dense.hash_embed(docs), "plan-vectors")
    text = plan(dense.search(vectors, retrieve.hash_questions(asked)))
    assert text.count("Exchange (") == 1  # only the ranking shuffles
    assert "MapInArrow" in text and "NestedLoop" not in text


def test_hybrid_has_no_cross_join(spark, docs, asked, tmp_path):
    path = str(tmp_path / "index")
    index_io.write_index(docs, path)
    picks = retrieve.hybrid_retrieve(index_io.open_index(spark, path), asked)
    text = plan(picks)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_scan_reads_only_the_columns_used(docs):
    text = plan(bm25.postings(bm25.tokenised(docs)))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
