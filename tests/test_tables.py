import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks import queries
from rowquarry.operators import chunks, clean, profile, rows
from rowquarry.plans import build
from rowquarry.session import scratch


def numbered(spark, n, columns=4):
    data = spark.range(n).select(*[(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(columns)])
    return rows.number_rows(data, ["c0"])


def test_rows_travel_without_copies_of_their_key(spark, monkeypatch):
    plans, write = [], rows.materialise
    monkeypatch.setattr(rows, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().toString()) or write(df, label))
    table = numbered(spark, 50)
    assert "__key_" not in plans[0] and table.columns == ["c0", "c1", "c2", "c3"]
    assert [r["c1"] for r in table.rows.orderBy(rows.ROW_ID).collect()] == [2 * i for i in range(50)]


def test_row_numbers_with_one_hot_leading_key(spark):
    rng = random.Random(1)
    data = [(0 if i % 3 else rng.randint(1, 9), i, f"v{i}") for i in range(3000)]
    rng.shuffle(data)
    table = rows.number_rows(spark.createDataFrame(data, "a int, b long, v string").repartition(7), ["a", "b"])
    got = [(r["a"], r["b"]) for r in table.rows.orderBy(rows.ROW_ID).collect()]
    assert got == sorted((a, b) for a, b, _ in data)
    ids = [r[0] for r in table.rows.select(rows.ROW_ID).collect()]
    assert sorted(ids) == list(range(3000)) and table.n_rows == 3000


def test_rows_at_places(spark):
    table = numbered(spark, 1000)
    got = table.at([0, 500, 999, 1000, -1]).orderBy(rows.ROW_ID).collect()
    assert [r["c0"] for r in got] == [0, 500, 999]
    assert numbered(spark, 0).at([0, 1]).count() == 0


def test_even_positions_match_numpy():
    for n in range(0, 700):
        for sample in (20, 25):
            k = min(sample, n)
            assert rows.even_positions(n, sample) == np.linspace(0, n - 1, k, dtype=int).tolist()


@pytest.mark.parametrize("window,overlap", [(10, 2), (12, 2), (8, 1), (3, 5), (4, -2)])
def test_windows_of_rows_match_slices(spark, window, overlap):
    step = max(1, window - overlap)
    for n in (1, 8, 10, 13, 31):
        made = spark.range(n).select(F.col("id"), F.explode(chunks.windows_of(F.col("id"), window, overlap)).alias("w"))
        got = sorted((r["w"], r["id"]) for r in made.collect())
        expected = [(w, i) for w, s in enumerate(range(0, n, step)) for i in range(s, min(s + window, n))]
        assert got == sorted(expected)
        assert chunks.window_count(n, window, overlap) == len(range(0, n, step))


@pytest.mark.parametrize("n", [0, 1, 8, 10, 13])
def test_row_window_texts(spark, n):
    got = chunks.row_window_chunks(numbered(spark, n, 2), "t").orderBy("row_start").collect()
    expected = []
    for s in range(0, n, 8):
        e = min(s + 10, n)
        expected.append(f"[Table: t | Rows {s + 1}–{e} of {n}]\n" + "\n".join(f"c0: {i} | c1: {2 * i}" for i in range(s, e)))
    assert [r["text"] for r in got] == expected


def test_column_group_and_hybrid_texts(spark):
    table = numbered(spark, 9, 7)
    got = chunks.column_group_chunks(table, "t%", row_sample=3, group_size=6).orderBy("col_group").collect()
    assert got[1]["text"] == "[Table: t% | Column Group 2/2: c6]\nc6: 0\nc6: 28\nc6: 56"
    made = chunks.hybrid_chunks(table, "t").orderBy("col_group", "row_start").collect()
    assert [(r["col_group"], r["row_start"], r["row_end"]) for r in made] == [(0, 0, 8), (0, 7, 9), (1, 0, 8), (1, 7, 9)]
    assert made[3]["text"] == "[Table: t | ColGroup 2 × Rows 8–9]\nc6: 49\nc6: 56"
    assert made[3]["cols"] == ["c6"]


def test_strategy_boundaries():
    picked = [chunks.pick_strategy(n, c) for n, c in [(100, 4), (101, 4), (500, 29), (501, 29), (200, 30), (201, 30)]]
    assert [(p[0], p[1].get("window")) for p in picked] == [
        ("row_window", 8), ("row_window", 10), ("row_window", 10), ("row_window", 12), ("column_group", None), ("hybrid", 8),
    ]
    with pytest.raises(ValueError):
        chunks.content_chunks(None, "t", "diagonal")


def test_all_chunks_in_order_with_contiguous_ids(spark):
    tables = {"small": numbered(spark, 9, 2), "empty": numbered(spark, 0, 2), "wide": numbered(spark, 9, 31)}
    got = build.build_chunks(tables, "test").orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in got] == list(range(len(got)))
    kinds = [(r["table"], r["chunk_type"]) for r in got]
    assert kinds == [
        ("_global", "overview"), ("small", "schema"), ("small", "stats"), ("small", "row_window"), ("small", "row_window"),
        ("empty", "schema"), ("empty", "stats"), ("wide", "schema"), ("wide", "stats"), *[("wide", "column_group")] * 4,
    ]
    named = build.build_chunks({"small": tables["small"]}, "test", strategy="hybrid").orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in named] == list(range(len(named)))
    assert got[0]["text"].startswith("=== GLOBAL OVERVIEW ===\nPurpose: test\nNumber of tables: 3\n  • small: 9 rows × 2 columns")


def test_names():
    assert [clean.normal_name(n) for n in (" Order ID ", "Größe (cm)", "€", "a.b", "__x__")] == ["order_id", "groe_cm", "col", "a_b", "x"]
    assert clean.unique_names(["a", "a", "a_1", "a"]) == ["a", "a_1", "a_1_1", "a_2"]


def dirty(spark):
    n = 100
    rows_ = []
    for i in range(n):
        rows_.append((str(i), f"{i},000", "x" if i % 10 == 0 else f"{i}.5", "x" if i % 5 == 0 else "1", "x" if i % 4 == 0 else "1", None, None))
    rows_ += rows_[:40]
    return spark.createDataFrame(rows_, "`Row No` string, big string, ninety string, eighty string, `seventy five` string, `Unnamed: 5` string, gap string")


def test_cleaning_rules(spark):
    cleaned = clean.clean(dirty(spark))
    types = dict(cleaned.dtypes)
    assert types == {"row_no": "bigint", "big": "bigint", "ninety": "double", "eighty": "string", "seventy_five": "string", "gap": "string"}
    got = {r["row_no"]: r for r in cleaned.collect()}
    assert len(got) == 100
    assert got[7]["big"] == 7000 and got[10]["ninety"] == 0.0 and got[11]["ninety"] == 11.5 and got[3]["gap"] == ""
    again = clean.clean(cleaned)
    assert again.dtypes == cleaned.dtypes and again.exceptAll(cleaned).count() == 0


def test_number_spellings(spark):
    texts = ["1", " 2\t", "1,234.5", "1e3", ".5", "5.", "-3", "+4", "1d", "1_0", "inf", "nan", "", "0x1", "1e", "--1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(clean.parsed_number(F.col("t"))).collect()]
    assert got[:8] == [1.0, 2.0, 1234.5, 1000.0, 0.5, 5.0, -3.0, 4.0] and got[8:] == [None] * 8


def test_first_copies_keep_their_order_and_null_differs_from_empty(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", ""), (3, "b", None), (4, "a", "")], "__at int, x string, y string")
    table = clean.clean_numbered(df, ["__at"])
    assert [(r["x"], r["y"]) for r in table.rows.orderBy(rows.ROW_ID).collect()] == [("b", ""), ("a", "")]
    two = spark.createDataFrame([(1, "a", None), (2, "a", "")], "__at int, x string, y string")
    assert clean.clean_numbered(two, ["__at"]).n_rows == 2


def test_profile_describe_and_top_values(spark):
    rng = random.Random(2)
    data = [(i, rng.choice(["x", "x", "y", "", "z'q"]), float(rng.randint(0, 40)) / 4, rng.random() < 0.5) for i in range(500)]
    frame = pd.DataFrame(data, columns=["i", "s", "f", "b"])
    table = rows.number_rows(spark.createDataFrame(frame), ["i"])
    got = {r["column"]: r for r in profile.profile(table).collect()}
    assert [got[c]["unique_count"] for c in "isfb"] == [frame[c].nunique() for c in "isfb"]
    assert [got[c]["dtype"] for c in "isfb"] == ["int64", "object", "float64", "bool"]
    assert got["s"]["null_count"] == (frame["s"] == "").sum() and got["f"]["null_count"] == 0
    assert got["f"]["sample_values"] == [str(v) for v in frame["f"][:5]]
    assert got["f"]["mean"] == pytest.approx(round(frame["f"].mean(), 4)) and got["b"]["max"] == 1.0
    described = {r["column"]: r for r in profile.describe(table.rows, ["i", "f"]).collect()}
    for c in ("i", "f"):
        expected = frame[c].describe().round(3)
        mine = described[c]
        assert [mine[k] for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(expected.tolist())
    top = [(r["value"], r["n"]) for r in profile.top_values(table).orderBy("rank").collect()]
    first = {v: frame.index[frame["s"] == v][0] for v in set(frame["s"])}
    assert top == sorted(frame["s"].value_counts().items(), key=lambda p: (-p[1], first[p[0]]))[:5]
    sketch = {r["column"]: r["unique_count"] for r in profile.profile(table, approx=True).collect()}
    assert abs(sketch["i"] - 500) < 50
    text = chunks.stats_text(table, "t").first()["text"]
    assert text.splitlines()[0] == "[Statistical Summary: t — 500 rows × 4 columns]"
    assert "\"z'q\":" in text and "b: " not in text


def test_quantiles_with_one_hot_value(spark):
    rng = random.Random(9)
    values = [5.0] * 700 + [rng.uniform(0, 10) for _ in range(1300)] + [None] * 50
    df = spark.createDataFrame([(v, 1.0) for v in values], "v double, one double").repartition(6)
    got = {(r["col_ord"], r["share"]): r["value"] for r in profile.quantiles(df, ["v", "one"], [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]).collect()}
    series = pd.Series([v for v in values if v is not None])
    for share in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0):
        assert got[0, share] == pytest.approx(series.quantile(share)) and got[1, share] == 1.0


def test_numbering_does_not_make_its_input_again(spark, monkeypatch):
    plans, write = [], rows.materialise
    monkeypatch.setattr(rows, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().toString()) or write(df, label))
    left, right = (spark.range(40).select((F.col("id") % 20).alias(k), (F.col("id") % 4).alias(c)) for k, c in (("a", "b"), ("k", "c")))
    joined = left.join(right, F.col("a") == F.col("k"))
    for order in (["a"], [F.col("a") * 2]):
        table = clean.clean_numbered(joined, order)
        assert [r["a"] for r in table.rows.orderBy(rows.ROW_ID).collect()] == list(range(20))
    assert plans and not any("Join" in plan or "Aggregate" in plan for plan in plans)


def test_hybrid_lines_are_written_after_the_shuffle(spark):
    long, wide = "é" * 199 + "xy", ["ab", "c" * 300]
    data = [(i, [None, "", "x" * 200, "y" * 201, long][i % 5], None if i % 4 == 0 else wide[: i % 3], i / 8, i * 3, (i, "n" * (i % 2 * 250))) for i in range(700)]
    table = rows.number_rows(spark.createDataFrame(data, "id long, window string, list array<string>, x double, lines long, r struct<a long, b string>"), ["id"])
    made = chunks.hybrid_chunks(table, "t", window=8, overlap=1, group_size=4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "concat_ws" in plan and "concat_ws" not in plan[plan.index("Exchange hashpartitioning") :]

    def cut(text):
        return text if len(text) <= 200 else text[:200] + "…"

    def line(row, group):
        i, text, items, x, n, (a, b) = row
        listed = "" if items is None else "[" + ", ".join(f"'{v}'" for v in items) + "]"
        record = '{"a":%d,"b":"%s"}' % (a, b)
        return [f"id: {i} | window: {cut(text or '')} | list: {cut(listed)} | x: {x}", f"lines: {n} | r: {cut(record)}"][group]

    got = {(r["col_group"], r["row_start"]): r for r in made.collect()}
    starts = range(0, 700, 7)
    assert sorted(got) == [(g, s) for g in (0, 1) for s in starts]
    for (g, s), r in got.items():
        e = min(s + 8, 700)
        assert r["row_end"] == e and r["text"] == f"[Table: t | ColGroup {g + 1} × Rows {s + 1}–{e}]\n" + "\n".join(line(row, g) for row in data[s:e])


def test_the_joined_rows_are_stored_until_they_are_numbered(spark, monkeypatch):
    plans, write = [], rows.materialise
    monkeypatch.setattr(rows, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().toString()) or write(df, label))
    with scratch(spark) as folder:
        made = queries.column_group_chunks(spark, "/root/testdata/sf0.001")
        assert [n.split("-")[0] for n in os.listdir(folder.removeprefix("file:"))] == ["rows"]
        assert made.count() == 4 and len(plans) == 1 and "Join" not in plans[0]
