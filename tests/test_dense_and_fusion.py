import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowquarry.functions.kernels import BestK, spread_picks
from rowquarry.operators import dense, fusion

RNG = np.random.default_rng(5)


def unit(n, d=8):
    v = RNG.normal(size=(n, d))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, vectors, name="doc_id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], f"{name} long, vec array<float>")


def brute(docs, query, k):
    scores = np.round(docs.astype(float) @ query.astype(float), 9)
    order = np.lexsort((np.arange(len(docs)), -scores))[:k]
    return [(int(i), scores[i]) for i in order]


def test_exact_search_with_copies_and_both_paths(spark):
    docs, asked = unit(300), unit(7)
    docs[100:200] = docs[3]  # a third are copies
    vectors, queries = frame(spark, docs).repartition(5), frame(spark, asked, "query_id")
    for options in ({}, {"max_broadcast_bytes": 0}):
        got = dense.search(vectors, queries, 20, **options).orderBy("query_id", "rank").collect()
        for q in range(7):
            mine = [(r["doc_id"], round(r["score"], 9)) for r in got if r["query_id"] == q]
            expected = brute(docs, asked[q], 20)
            assert [d for d, _ in mine] == [d for d, _ in expected]
            assert [s for _, s in mine] == pytest.approx([s for _, s in expected])


def test_fewer_documents_than_asked_and_no_questions(spark):
    vectors = frame(spark, unit(3))
    assert dense.search(vectors, frame(spark, unit(2), "query_id"), 20).count() == 6
    none = frame(spark, unit(1), "query_id").filter("query_id < 0")
    assert dense.search(vectors, none, 20).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 5), st.integers(1, 9), st.integers(1, 40))
def test_running_best_does_not_depend_on_blocks(n, q, k, cells):
    rng = np.random.default_rng(n * 1000 + q)
    docs, asked = rng.integers(-2, 3, size=(n, 3)).astype(np.float32), rng.integers(-2, 3, size=(q, 3)).astype(np.float32)
    best = BestK(asked, k, max_cells=cells)
    best.add(np.arange(n), docs)
    for i in range(q):
        mine = [(int(d), s) for d, s, o in zip(best.ids, best.scores, best.owner) if o == i]
        assert mine == brute(docs, asked[i], k)


def test_hash_embedding_is_unit_and_empty_text_is_zero(spark):
    docs = spark.createDataFrame([(1, "a b c a"), (2, ""), (3, "é"), (4, "c a b a")], "doc_id long, text string")
    vec = {r["doc_id"]: np.array(r["vec"]) for r in dense.hash_embed(docs).collect()}
    assert np.linalg.norm(vec[1]) == pytest.approx(1, abs=1e-6)
    assert not vec[2].any() and not vec[3].any() and len(vec[2]) == 64
    assert (vec[1] == vec[4]).all()


def test_model_encoder_is_loaded_per_task_and_normalised(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    docs = spark.createDataFrame([(i, "x" * i) for i in range(200)], "doc_id long, text string")
    got = {r["doc_id"]: r["vec"] for r in dense.encode(docs, load, batch_size=16).collect()}
    assert len(got) == 200
    assert got[3] == pytest.approx([3 / 10**0.5, 1 / 10**0.5])


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank int")


def test_fusion_of_two_lists_with_ties(spark):
    first = lists(spark, [(1, 10, 9.0, 1), (1, 11, 8.0, 2), (1, 12, 7.0, 3)])
    second = lists(spark, [(1, 12, 0.9, 1), (1, 13, 0.8, 2), (2, 5, 0.1, 1)])
    got = fusion.best_fused(fusion.fuse([first, second]), 10).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(1, 12), (1, 10), (1, 11), (1, 13), (2, 5)]
    assert got[0]["score"] == pytest.approx(1 / 63 + 1 / 61)
    assert got[2]["score"] == got[3]["score"]  # the first list goes first


def plain_mmr(query, docs, k, share):
    left, picked = list(range(len(docs))), []
    while left and len(picked) < k:
        values = []
        for i in left:
            value = float(docs[i] @ query)
            if picked:
                value = share * value - (1 - share) * max(float(docs[i] @ docs[j]) for j in picked)
            values.append(round(value, 9))
        picked.append(left.pop(int(np.argmax(values))))
    return picked


def test_diversified_picks_agree_with_a_plain_loop(spark):
    docs, asked = unit(40).astype(float), unit(6).astype(float)
    docs[10:16] = docs[2]
    size = [40, 24, 5, 1, 18, 24]
    rows = [(q, i, docs[i].tolist(), i + 1) for q in range(6) for i in range(size[q])]
    candidates = spark.createDataFrame(rows, "query_id long, doc_id long, vec array<double>, rank int")
    queries = spark.createDataFrame([(q, asked[q].tolist(), 8 if q % 2 else 6) for q in range(6)], "query_id long, vec array<double>, k int")
    got = fusion.diversify(candidates, queries, 0.65, picks="k").orderBy("query_id", "rank").collect()
    for q in range(6):
        expected = plain_mmr(asked[q], docs[: size[q]], 8 if q % 2 else 6, 0.65)
        assert [r["doc_id"] for r in got if r["query_id"] == q] == expected


def test_share_one_is_similarity_order_and_zero_spreads():
    docs = np.array([[[1.0, 0], [0.9, 0.1], [0.0, 1.0], [0.8, 0.2]]])
    query, valid = np.array([[1.0, 0.0]]), np.ones((1, 4), dtype=bool)
    assert spread_picks(query, docs, valid, np.array([4]), 1.0)[0].tolist() == [0, 1, 3, 2]
    assert spread_picks(query, docs, valid, np.array([2]), 0.0)[0].tolist() == [0, 2]


def test_picks_do_not_depend_on_how_many_questions_are_solved_at_once(monkeypatch):
    rng = np.random.default_rng(2)
    query = pd.Series(list(rng.normal(size=(9, 6))))
    count = pd.Series(rng.integers(1, 7, 9))
    flat = pd.Series([rng.normal(size=n * 6) for n in count])
    pick = fusion._picker(0.65).func
    whole = pick(query, flat, count, pd.Series([3] * 9))
    monkeypatch.setattr(fusion, "MAX_CELLS", 1)
    for one, other in zip(pick(query, flat, count, pd.Series([3] * 9)), whole):
        assert one.tolist() == other.tolist()


def test_memory_of_ranking_does_not_grow_with_a_batch():
    rng = np.random.default_rng(5)
    asked, vectors = rng.normal(size=(400, 16)), rng.normal(size=(12_000, 16))
    tracemalloc.start()
    found = BestK(asked, 20)
    found.add(np.arange(12_000), vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    scores = np.round(asked @ vectors.T, 9)
    for q in (0, 399):
        expected = np.lexsort((np.arange(12_000), -scores[q]))[:20]
        assert found.ids[found.owner == q].tolist() == expected.tolist()
