"""One counting pass against the plain functions and pandas; sketches; quoted values; empty tables; streams in batches."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowquarry.operators import chunks, clean, counted, profile
from rowquarry.operators.rows import number_rows
from rowquarry.plans import build
from rowquarry.session import scratch, scratch_path
from rowquarry.streaming import memory


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    first = [(i, rng.choice(["x", "y", "", "q'r"]), rng.choice([0.5, -2.0, 7.25, 100.0]), rng.random() < 0.3, None) for i in range(400)]
    second = [(rng.choice("abc") * 3, 5) for _ in range(90)]
    one = spark.createDataFrame(first, "i long, s string, f double, b boolean, gone string")
    return {"one": number_rows(one, ["i"]), "two": number_rows(spark.createDataFrame([(*r, i) for i, r in enumerate(second)], "t string, c int, k int"), ["k"])}


@pytest.mark.parametrize("few", [counted.FEW_VALUES, 10])
def test_one_pass_equals_the_plain_functions(spark, tables, monkeypatch, few):
    monkeypatch.setattr(counted, "FEW_VALUES", few)
    measured = counted.measure(tables)
    for i, table in enumerate(tables.values()):
        own = counted.profiles(measured).filter(F.col("table_ord") == i).drop("table_ord")
        plain = profile.profile(table).select(own.columns)
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, plain.collect()))
        names = [f.name for f in table.fields if profile.is_number(f)]
        described = counted.descriptions(measured).filter(F.col("table_ord") == i)
        got = {r["column"]: tuple(r)[3:] for r in described.collect()}
        want = {r["column"]: tuple(r)[2:] for r in profile.describe(table.rows, names).collect()}
        assert got == {c: pytest.approx(v) for c, v in want.items()}
        top = measured.top.filter(F.col("table_ord") == i).select("col_ord", "value", "n", "rank").collect()
        assert sorted(map(tuple, top)) == sorted(tuple(r) for r in profile.top_values(table).select("col_ord", "value", "n", "rank").collect())


def test_sketches(spark, tables):
    exact, sketch = counted.measure(tables), counted.measure(tables, approx=True)
    for a, b in zip(exact.columns, sketch.columns):
        assert a[:5] == b[:5] and a[6:8] == b[6:8]
        assert abs(a[5] - b[5]) <= max(1, 0.1 * a[5])
        assert all((x is None) == (y is None) for x, y in zip(a[8:], b[8:])) and a[8:10] == b[8:10]
    sizes = {(r["table_ord"], r["col_ord"], r["value"]): r["n"] for r in exact.top.collect()}
    assert {(r["table_ord"], r["col_ord"], r["value"]): r["n"] for r in sketch.top.collect()} == sizes
    texts = [r["text"] for r in build.build_chunks(tables, "d", approx=True).filter("chunk_type in ('schema', 'stats')").collect()]
    assert len(texts) == 4 and any(t.startswith("[Statistical Summary: two — 90 rows") for t in texts)


def test_few_jobs_for_all_tables(spark, tables):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counting", "count")
    try:
        build.build_chunks(tables, "d").collect()
        jobs = len(tracker.getJobIdsForGroup("counting"))
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert jobs < 30


def test_chunk_counts_follow_from_shapes(spark, tables):
    for strategy in ("auto", *chunks.STRATEGIES):
        assert build.build_chunks(tables, "d", strategy).count() == build.count_chunks(tables, strategy)
    total = build.corpus_totals(tables).first()
    assert (total["total_rows"], total["total_chunks"]) == (490, build.count_chunks(tables))


def test_tables_without_rows(spark):
    wide = spark.createDataFrame([], ", ".join(f"c{i} long" for i in range(31)))
    empty = {"wide": number_rows(wide, ["c0"]), "bare": number_rows(spark.createDataFrame([], "a long, b string"), ["a"])}
    made = build.build_chunks(empty, "d").orderBy("chunk_id").collect()
    assert len(made) == build.count_chunks(empty) and [r["chunk_id"] for r in made] == list(range(len(made)))
    groups = [r for r in made if r["chunk_type"] == "column_group"]
    assert len(groups) == 4 and groups[0]["text"] == "[Table: wide | Column Group 1/4: c0, c1, c2, c3, c4, c5, c6, c7]\n"


def test_quoted_values_as_python_writes_them(spark):
    values = ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash", "line\nbreak\ttab\r", "bell\x07 del\x7f nbsp\xa0 é €", "\\'", ""]
    frame = spark.createDataFrame([(v,) for v in values], "v string").select("v", chunks._quoted_value(F.col("v")).alias("q"))
    assert {r["v"]: r["q"] for r in frame.collect()} == {v: repr(v) for v in values}


def messages(n, seed):
    rng = random.Random(seed)
    rows, turn = [], {}
    for _ in range(n):
        conv = rng.choice([1, 1, 1, 1, 2, 3, 4])  # one conversation holds most messages
        turn[conv] = turn.get(conv, 0) + 1
        rows.append((conv, turn[conv], rng.choice(["user", "assistant"]), f"m{conv}-{turn[conv]}"))
    return rows


def test_a_stream_in_batches_with_late_turns_and_a_restart(spark):
    rows = messages(300, 6)
    parts = [rows[:40], rows[60:61] + rows[41:60], rows[40:41], rows[61:200], rows[200:], []]
    with scratch(spark):
        folder, path, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "check"))
        spark.createDataFrame([], memory.MESSAGE_SCHEMA).write.parquet(folder)
        for part in parts:
            spark.createDataFrame(part, memory.MESSAGE_SCHEMA).write.mode("append").parquet(folder)
            got = memory.run_ordered(memory.read_messages(spark, folder), path, checkpoint, size=3, block_rows=16, merge_every=2)
        got = sorted((r["conv_id"], r["turn"], [m["text"] for m in r["frame"]]) for r in got.collect())
    want, held = [], {}
    for part in parts:
        for conv, turn, role, text in sorted(part):
            held[conv] = [*held.get(conv, []), text][-3:]
            if role == "user":
                want.append((conv, turn, held[conv]))
    assert got == sorted(want)


def test_cleaning_keeps_hidden_order_columns_out(spark):
    frame = pd.DataFrame({"x y": ["b", "a", "b"], "o.1": [3, 1, 2]})
    table = clean.clean_numbered(spark.createDataFrame(frame), ["o.1"], hidden=("o.1",))
    assert table.columns == ["x_y"] and [r["x_y"] for r in table.rows.orderBy("__row_id").collect()] == ["a", "b"]
