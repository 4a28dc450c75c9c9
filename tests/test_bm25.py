import math
import random
from collections import Counter

import pytest

from rowquarry.operators import bm25, dense

DOCS = [(0, "red apple red"), (1, "green apple"), (2, "")]


def plain_scores(docs, query):
    """BM25 as defined, one document at a time."""
    tokens = {i: text.split() for i, text in docs}
    mean = sum(map(len, tokens.values())) / max(len(docs), 1)
    df = Counter(t for toks in tokens.values() for t in set(toks))
    out = {}
    for i, toks in tokens.items():
        counts, total = Counter(toks), 0.0
        for t in query.split():
            if counts[t]:
                idf = math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1)
                total += idf * counts[t] * 2.5 / (counts[t] + 1.5 * (0.25 + 0.75 * len(toks) / mean))
        if total > 0:
            out[i] = total
    return out


def frame(spark, docs, id_name="doc_id"):
    return spark.createDataFrame(docs, f"{id_name} long, text string")


def ranked(df):
    return {(r["query_id"], r["rank"]): (r["doc_id"], round(r["score"], 9)) for r in df.collect()}


def test_three_documents_by_hand(spark):
    index = bm25.index_documents(frame(spark, DOCS))
    stats = index.stats.first()
    assert (stats["n"], stats["total"]) == (3, 5)
    assert stats["avgdl"] == pytest.approx(5 / 3)
    terms = {r["term"]: (r["df"], r["idf"]) for r in bm25.term_stats(index.postings, index.stats).collect()}
    assert terms["apple"][0] == 2 and terms["red"][0] == 1
    assert terms["red"][1] == pytest.approx(math.log(2.5 / 1.5 + 1))
    got = ranked(bm25.search(index, frame(spark, [(7, "red apple")], "query_id")))
    expected = plain_scores(DOCS, "red apple")
    assert [got[7, 1][0], got[7, 2][0]] == [0, 1]
    assert got[7, 1][1] == pytest.approx(expected[0])
    assert (7, 3) not in got  # the empty document shares no term


def test_empty_question_finds_nothing_and_repeats_count(spark):
    index = bm25.index_documents(frame(spark, DOCS))
    got = bm25.search(index, frame(spark, [(1, ""), (2, "!!"), (3, "red"), (4, "red red")], "query_id")).collect()
    scores = {r["query_id"]: r["score"] for r in got}
    assert set(scores) == {3, 4}
    assert scores[4] == pytest.approx(2 * scores[3])


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_agrees_with_plain_python_at_any_partitioning(spark, partitions):
    rng = random.Random(3)
    words = ["the"] * 8 + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(120)]
    docs += [(200 + i, docs[5][1]) for i in range(60)]  # a third are copies
    asked = [(i, " ".join(rng.choices(words, k=5))) for i in range(12)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        index = bm25.index_documents(frame(spark, docs).repartition(partitions))
        small = ranked(bm25.search(index, frame(spark, asked, "query_id"), 20))
        blocks = ranked(bm25.search(index, frame(spark, asked, "query_id"), 20, max_block_bytes=1000))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert small == blocks
    for query_id, text in asked:
        best = sorted(plain_scores(docs, text).items(), key=lambda p: (-round(p[1], 9), p[0]))[:20]
        assert [small[query_id, i + 1][0] for i in range(len(best))] == [d for d, _ in best]
        assert [small[query_id, i + 1][1] for i in range(len(best))] == pytest.approx([s for _, s in best])
        assert (query_id, len(best) + 1) not in small


def test_a_task_counts_the_words_of_a_bounded_text(spark, monkeypatch):
    docs = frame(spark, [(i, f"w{i % 9} apple " * 20) for i in range(400)])
    asked = frame(spark, [(1, "w3 apple"), (2, "w5")], "query_id")
    size = sum(len(r["text"]) for r in docs.collect())
    want = ranked(bm25.search(bm25.index_documents(docs), asked)), sorted(map(tuple, dense.hash_embed(docs).collect()))
    monkeypatch.setattr(bm25, "TASK_BYTES", 4000)
    index = bm25.index_documents(docs)
    for counted in (index.postings, dense.hash_embed(docs)):
        assert counted.rdd.getNumPartitions() == -(-size // 4000) > 16
    assert (ranked(bm25.search(index, asked)), sorted(map(tuple, dense.hash_embed(docs).collect()))) == want
