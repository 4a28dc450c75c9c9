import json
import os
from threading import Lock

import pytest
from pyspark.sql import functions as F

from checks import queries
from rowquarry.operators.rows import ROW_ID
from rowquarry.operators.clean import clean as clean_frame
from rowquarry.plans import build
from rowquarry.session import scratch
from rowquarry.sources import files

ROWS = [("1", "Ann Lee", "1,200", "2024-01-01"), ("2", "Bob", "950", "2024-01-02"), ("3", "Zoë", "7", "2024-01-03")]
HEADER = ("Order ID", "Customer Name", "Amount", "Order Date")


def delimited(sep):
    def cell(v):
        return f'"{v}"' if sep in v or "," in v else v

    return "\n".join(sep.join(cell(v) for v in row) for row in [HEADER, *ROWS]) + "\n"


@pytest.fixture
def loaded(spark, tmp_path):
    def load(contents):
        for name, body in contents.items():
            (tmp_path / name).write_bytes(body if isinstance(body, bytes) else body.encode())
        result = files.load_tables(spark, str(tmp_path))
        return result, {r["table"]: r for r in result.manifest.collect()}

    return load


def values(table):
    return [tuple(r) for r in table.rows.orderBy(ROW_ID).select(*table.columns).collect()]


def test_separators_and_types(loaded):
    result, manifest = loaded(
        {"comma.csv": delimited(","), "semi colon.csv": delimited(";"), "Pipe.txt": delimited("|"), "tab.tsv": delimited("\t"), "space.txt": delimited(" ")}
    )
    found = {name: row["separator"] for name, row in manifest.items()}
    assert found == {"comma": ",", "semi_colon": ";", "pipe": "|", "tab": "\t", "space": " "}
    for name in found:
        table = result.tables[name]
        assert [(f.name, f.dataType.simpleString()) for f in table.fields] == [
            ("order_id", "bigint"), ("customer_name", "string"), ("amount", "bigint"), ("order_date", "string"),
        ]
        assert values(table)[0] == (1, "Ann Lee", 1200, "2024-01-01") and table.n_rows == 3
    assert manifest["pipe"]["n_cols"] == 4 and manifest["pipe"]["errors"] == []


def test_encodings_and_byte_order_mark(loaded):
    text = "name,city\nZoë,Köln\n"
    latin = text.encode("latin-1")
    result, manifest = loaded({"latin1.csv": latin, "latin + two.csv": latin, "bom.csv": text.encode("utf-8-sig"), "plain.csv": text})
    found = {k: v["encoding"] for k, v in manifest.items()}
    assert found == {"latin1": "latin-1", "latin_+_two": "latin-1", "bom": "utf-8", "plain": "utf-8"}
    for table in result.tables.values():
        assert values(table) == [("Zoë", "Köln")] and table.columns == ["name", "city"]


def test_ragged_lines_missing_values_and_headers(loaded):
    result, _ = loaded(
        {
            "ragged.csv": "a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,11,12,\n",
            "gaps.csv": 'x,y\nNA,"q ""z"""\nn/a,b\n<NA>,None\nreal,\n',
            "heads.csv": "a,A,a_1,,Unnamed: 4\n1,2,3,4,5\n",
        }
    )
    assert values(result.tables["ragged"]) == [(1, 2, 3), (4, 5, 0), (10, 11, 12)] or values(result.tables["ragged"]) == [
        (1, 2, "3"), (4, 5, ""), (10, 11, "12"),
    ]
    assert values(result.tables["gaps"]) == [("", 'q "z"'), ("", "b"), ("", ""), ("real", "")]
    assert result.tables["heads"].columns == ["a", "a_1", "a_1_1"]


RECORDS = [{"id": 1, "user": {"name": "x", "tags": ["a"]}, "big": 1.5}, {"id": 2, "user": {"name": "y", "tags": []}, "big": 2.0, "late": True}]


def test_json_shapes(loaded):
    result, manifest = loaded(
        {
            "array.json": json.dumps(RECORDS, indent=1),
            "wrapped.json": json.dumps({"meta": 1, "records": RECORDS}),
            "both.json": json.dumps({"rows": [{"z": 1}], "data": [{"y": 2}]}),
            "columns.json": json.dumps({"x": [1, 2, 3], "y": ["a", "b", "c"]}),
            "uneven.json": json.dumps({"x": [1, 2, 3], "y": ["a"]}),
            "lines.jsonl": "\n\n".join(json.dumps(r) for r in RECORDS) + "\n",
            "one.jsonl": json.dumps(RECORDS[0]) + "\n",
            "broken.jsonl": '{"a": 1}\n{"a": \n',
            "empty.json": "[]",
            "notes.pdf": "x",
        }
    )
    for name in ("array", "wrapped", "lines"):
        table = result.tables[name]
        assert table.columns == ["id", "user_name", "user_tags", "big", "late"]
        assert values(table) == [(1, "x", ["a"], 1.5, False), (2, "y", [], 2.0, True)]
    assert values(result.tables["both"]) == [(2,)]
    assert values(result.tables["columns"]) == [(1, "a"), (2, "b"), (3, "c")]
    assert values(result.tables["one"]) == [(1, "x", ["a"], 1.5)]
    assert sorted(k for k, v in manifest.items() if v["errors"]) == ["broken", "empty", "notes", "uneven"]
    assert manifest["notes"]["errors"] == ["Unsupported file type: .pdf"] and manifest["array"]["file_type"] == "JSON"


def test_file_order_is_kept_over_part_files(spark, tmp_path):
    spark.range(5000).select(F.format_string("r%d", "id").alias("name"), (F.col("id") * 3).alias("v")).repartitionByRange(5, "v").sortWithinPartitions(
        "v"
    ).write.csv(str(tmp_path / "parts.csv"), header=True)
    table = files.load_tables(spark, str(tmp_path)).tables["parts"]
    assert [r["v"] for r in table.rows.orderBy(ROW_ID).collect()] == [3 * i for i in range(5000)]
    single = files.load_tables(spark, str(tmp_path / "parts.csv")).tables["parts"]
    assert single.n_rows == 5000


def test_one_document_by_uri(spark, tmp_path):
    (tmp_path / "doc.json").write_text(json.dumps({"data": RECORDS}))
    for path in (f"file://{tmp_path}", f"file://{tmp_path}/doc.json"):
        assert files.load_tables(spark, path).tables["doc"].n_rows == 2


def test_table_names():
    assert files.table_name("/x/My Sales Data.csv") == "my_sales_data"
    assert len(files.table_name("/x/" + "a" * 60 + ".csv")) == 40


def test_names_with_two_underscores_are_the_users(spark, tmp_path):
    (tmp_path / "api.jsonl").write_text('{"__typename": "A", "id": 1}\n{"__typename": "B", "id": 1}\n')
    loaded = files.load_tables(spark, str(tmp_path))
    table = loaded.tables["api"]
    assert table.n_rows == 2 and sorted(table.columns) == ["id", "typename"]


def test_near_decimals_are_different_rows(spark):
    df = spark.sql("select * from values (123456789012345567.01BD), (123456789012345567.02BD) as t(x)")
    assert clean_frame(df).count() == 2


def test_a_broken_parquet_file_leaves_the_others(spark, tmp_path):
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 not really PAR1")
    (tmp_path / "good.csv").write_text("a,b\n1,x\n2,y\n")
    loaded = files.load_tables(spark, str(tmp_path))
    assert list(loaded.tables) == ["good"]
    assert {r["table"]: bool(r["errors"]) for r in loaded.manifest.collect()} == {"bad": True, "good": False}


def test_folders_with_dots_in_their_names(spark, tmp_path):
    (tmp_path / "exports.2024").mkdir()
    (tmp_path / "exports.2024" / "good.csv").write_text("a,b\n1,x\n")
    assert [t.n_rows for t in files.load_tables(spark, str(tmp_path)).tables.values()] == [1]
    assert [t.n_rows for t in files.load_tables(spark, str(tmp_path / "exports.2024")).tables.values()] == [1]


def test_json_results_do_not_depend_on_size(loaded):
    long, wide = "x" * 5000, "y" * 70_000
    records = [{"z": 1, "b": {"k": wide, "a": 2}, "c": 3}, {"z": 2, "b": {"k": "s", "a": 4}, "c": 5}]
    rows = ",\n".join('{"z": %d,\n"c": 1}' % i for i in range(3))
    result, manifest = loaded(
        {
            "laid_out.json": '{"meta": {"data": 1, "note": "%s"}, "data": [\n%s\n]}' % (long, rows),
            "lines.jsonl": "\n".join(json.dumps(r) for r in records),
            "array.json": json.dumps(records),
            "tall.json": json.dumps([{"z": 1, "list": list(range(500)), "c": 3}], indent=1),
            "broken.jsonl": json.dumps({"a": long}) + '\n{"a": \n',
        }
    )
    assert [k for k, r in manifest.items() if r["errors"]] == ["broken"]
    assert values(result.tables["laid_out"]) == [(0, 1), (1, 1), (2, 1)] and result.tables["laid_out"].columns == ["z", "c"]
    for name in ("lines", "array"):
        assert result.tables[name].columns == ["z", "b_k", "b_a", "c"]
    assert result.tables["tall"].columns == ["z", "list", "c"]


def test_a_table_with_a_header_and_no_rows_is_kept(loaded):
    result, manifest = loaded({"bare.csv": "a,b\n", "full.csv": "a,b\n1,2\n"})
    assert result.tables["bare"].columns == ["a", "b"] and result.tables["bare"].n_rows == 0
    assert (manifest["bare"]["n_rows"], manifest["bare"]["errors"]) == (0, [])
    chunks = build.build_chunks(result.tables, "Answer questions").collect()
    assert chunks


def test_separator_of_quoted_prose(loaded):
    prose = "one two, three four\n" * 30
    rows = "".join(f'"{i}","he said ""{i}""\n{prose}","end, {i}"\n' for i in range(3))
    lines = "".join(f'{i};"a b c d e f, g";{i}\n' for i in range(30))
    result, manifest = loaded({"breaks.csv": f"doc_id,body,tag\n{rows}", "marked.csv": f'﻿"doc_id","body","tag"\n{rows}', "lines.csv": f"id;text;n\n{lines}", "wide.csv": 'id,size\n1,5" wide\n2,7 "a" wide\n'})
    assert {name: row["separator"] for name, row in manifest.items()} == {"breaks": ",", "marked": ",", "lines": ";", "wide": ","}
    for name in ("breaks", "marked"):
        assert values(result.tables[name]) == [(i, f'he said "{i}"\n{prose}', f"end, {i}") for i in range(3)]
    assert values(result.tables["lines"])[7] == (7, "a b c d e f, g", 7) and result.tables["lines"].n_rows == 30
    assert values(result.tables["wide"]) == [(1, '5" wide'), (2, '7 "a" wide')]


def test_large_tables_are_cleaned_one_after_the_other(loaded, monkeypatch):
    running, most, lock, clean_one = [0], [0], Lock(), files._cleaned

    def counted(scan):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        try:
            return clean_one(scan)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(files, "_cleaned", counted)
    monkeypatch.setattr(files, "SIDE_BY_SIDE_BYTES", 60)
    found, _ = loaded({"a.csv": "x,y\n" + "1,2\n" * 3, "b.csv": "x,y\n" + "".join(f"{i},5\n" for i in range(40)), "c.tsv": "x\ty\n3\t4\n", "d.jsonl": '{"x": 7, "y": 8}\n'})
    assert {name: values(t) for name, t in found.tables.items()} == {"a": [(1, 2)], "b": [(i, 5) for i in range(40)], "c": [(3, 4)], "d": [(7, 8)]}
    assert most[0] <= 2

    def sizes(*n_bytes):
        scans = [files.Scan(files.Source("p", "p", ".csv", n), "CSV") for n in n_bytes]
        return [[s.source.n_bytes for s in group] for group in files._groups(scans)]

    assert sizes(20, 40, 1, 59, 900, 60, 0) == [[20, 40], [1, 59], [900], [60, 0]] and sizes() == []


def test_loaded_files_are_deleted_before_their_rows_are_read(spark):
    with scratch(spark) as folder:
        rows = queries.encoded_scan(spark, "/root/testdata/sf0.001")
        left = {n.split("-")[0] for n in os.listdir(folder.removeprefix("file:"))}
        assert "encoded" not in left and "rows" in left
        assert {(r["table"], r["n"]) for r in rows.groupBy("table").agg(F.count("*").alias("n")).collect()} == {
            (name, 200) for name in ("win", "latin", "low", "high", "lines", "list")
        }
