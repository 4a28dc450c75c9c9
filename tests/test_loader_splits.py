"""Files cut into very many splits: quoted line breaks, JSON documents, encodings, unlike parts, keys in any case."""

import csv
import io
import json
import random

import pytest

from rowquarry.operators.rows import ROW_ID, number_rows
from rowquarry.sources import files, json_documents, json_records, quoted_lines
from rowquarry.sources.splits import chunks

SPLIT = {"spark.sql.files.maxPartitionBytes": "83", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture
def tiny_splits(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def write(folder, contents):
    for name, body in contents.items():
        target = folder / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body if isinstance(body, bytes) else body.encode())


def load(spark, folder):
    loaded = files.load_tables(spark, str(folder))
    return loaded.tables, {r["table"]: r for r in loaded.manifest.collect()}


def values(table):
    return [tuple(r) for r in table.rows.orderBy(ROW_ID).select(*table.columns).collect()]


def quoted_rows(n, seed):
    rng = random.Random(seed)
    bits = ["x", "a,b", "line\nbreak", 'say ""no""', "\n\n", 'q"q', "ü€", "end\r\nof", "", "long " * 30, ",", '"']
    return [[f"r{i}", *["".join(rng.choices(bits, k=rng.randint(0, 4))) for _ in range(2)]] for i in range(n)]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_quoted_line_breaks_over_many_splits(spark, tmp_path, tiny_splits, ending):
    rows = quoted_rows(60, 1)
    out = io.StringIO()
    csv.writer(out, lineterminator=ending).writerows([["id", "first\nhalf", "second"], *rows])
    body = out.getvalue() + f'plain,5" disk,it"s{ending}{ending}last,"open\nand closed",z'
    write(tmp_path, {"q.csv": body})
    source = {"utf-8": [str(tmp_path / "q.csv")]}
    assert chunks(spark, source, "\n").rdd.getNumPartitions() > 30
    assert quoted_lines.has_breaks(spark, source, ",")
    tables, manifest = load(spark, tmp_path)
    assert tables["q"].columns == ["id", "first_half", "second"] and manifest["q"]["errors"] == []
    want = [*map(tuple, rows), ("plain", '5" disk', 'it"s'), ("last", "open\nand closed", "z")]
    same = [tuple(v.replace("\r\n", "\n") for v in r) for r in values(tables["q"])]
    assert same == [tuple(v.replace("\r\n", "\n") for v in r) for r in want]


def test_no_quoted_breaks_and_an_open_quote(spark, tmp_path, tiny_splits):
    write(tmp_path, {"plain.csv": 'a,b\n1,"x, y"\n2,5" z\n', "open.csv": 'a,b\n1,"x\n2,y\n' + "3,z\n" * 50})
    assert not quoted_lines.has_breaks(spark, {"utf-8": [str(tmp_path / "plain.csv")]}, ",")
    tables, manifest = load(spark, tmp_path)
    assert list(tables) == ["plain"] and values(tables["plain"]) == [(1, "x, y"), (2, '5" z')]
    assert manifest["open"]["errors"] == ["CSV parse error: a quoted field has no end"]


def test_states_of_lines_by_brute_force():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 12))
        outside, inside = rng.integers(0, 2, n).astype(bool), rng.integers(0, 2, n).astype(bool)
        for state in (0, 1):
            want, now = [], state
            for o, i in zip(outside, inside):
                now = int(i if now else o)
                want.append(now)
            assert quoted_lines._states(state, outside, inside).astype(int).tolist() == want


def records(n, seed):
    rng = random.Random(seed)
    words = ["x", "}", "{", "[1,2]", '"', "\\", "é", "],", "a,b", "\n", ""]
    made = []
    for i in range(n):
        r = {"id": i, "Text": "".join(rng.choices(words, k=rng.randint(0, 6))), "user": {"name": rng.choice(words), "tags": rng.sample(words, 2)}}
        if i % 7 == 3:
            r["late"] = i / 2
        made.append(r)
    return made


def flat(rows):
    return [(r["id"], r["Text"], r["user"]["name"], r["user"]["tags"], r.get("late", 0.0)) for r in rows]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_documents_over_many_splits(spark, tmp_path, tiny_splits, indent):
    rows = records(40, 2)
    lists = {"k}": [r["id"] for r in rows], "Text": [r["Text"] for r in rows], "n": 7, "tags": [r["user"]["tags"] for r in rows]}
    write(
        tmp_path,
        {
            "array.json": json.dumps(rows, indent=indent),
            "wrapped.json": json.dumps({"n": 1, "meta": {"data": [5]}, "results": [], "items": rows, "more": [{"z": "]}"}]}, indent=indent, ensure_ascii=False),
            "lists.json": json.dumps(lists, indent=indent) + "\n",
            "cut.json": json.dumps(rows, indent=indent)[:-1],
            "cut_wrapped.json": json.dumps({"items": rows}, indent=indent).rstrip("}\n"),
            "uneven.json": json.dumps({"a": [1, 2, 3], "b": [{"c": 1}]}, indent=indent),
            "numbers.json": json.dumps([1, 2, 3], indent=indent),
            "mixed.json": json.dumps({"a": [1], "b": {"c": 1}}, indent=indent),
            "single.json": json.dumps(rows[3], indent=indent),
            "parts.json/1": json.dumps(rows[:5], indent=indent),
            "parts.json/2": json.dumps(rows[5:11], indent=indent),
        },
    )
    assert chunks(spark, {"utf-8": [str(tmp_path / "array.json")]}, "}").rdd.getNumPartitions() > 20
    tables, manifest = load(spark, tmp_path)
    # "results" comes before "items" in the order of the keys of records, and holds none.
    failed = {"cut", "cut_wrapped", "uneven", "numbers", "mixed", "wrapped"}
    assert {k for k, r in manifest.items() if r["errors"]} == failed
    assert values(tables["array"]) == flat(rows) and tables["array"].columns == ["id", "text", "user_name", "user_tags", "late"]
    assert tables["lists"].columns == ["k", "text", "n", "tags"]
    assert values(tables["lists"]) == [(r["id"], r["Text"], 7, r["user"]["tags"]) for r in rows]
    assert values(tables["single"]) == flat(rows[3:4])
    assert values(tables["parts"]) == flat(rows[:11])


def test_wrapped_records_over_many_splits(spark, tmp_path, tiny_splits):
    rows = records(30, 5)
    write(tmp_path, {"w.json": json.dumps({"meta": {"a": "]"}, "items": rows, "rows": [{"z": 1}], "n": "}"}, indent=2)})
    assert values(load(spark, tmp_path)[0]["w"]) == flat(rows)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16-le"])
def test_long_lists_without_a_brace_are_read_in_small_pieces(spark, tmp_path, tiny_splits, encoding):
    lists = {"k": list(range(300)), "t": [f"a,b {i}" for i in range(300)], "n": "x,]", "f": [i / 2 for i in range(300)]}
    body = json.dumps(lists)
    write(tmp_path, {"l.json": (b"\xff\xfe" if encoding != "utf-8" else b"") + body.encode(encoding), "comma.json": body + ",", "open.json": body[:-1]})
    parts, _ = json_documents.pieces(spark, {encoding: [str(tmp_path / "l.json")]})
    assert max(len(r["text"]) for r in parts.collect()) < 40
    tables, manifest = load(spark, tmp_path)
    assert [k for k, r in manifest.items() if r["errors"]] == ["comma", "open"]
    assert values(tables["l"]) == [(i, f"a,b {i}", "x,]", i / 2) for i in range(300)]


def test_keys_in_any_case_and_order_of_appearance(spark, tmp_path, tiny_splits):
    lines = [{"b": 1, "A": 2, "a": "x"}, {"a": "y", "u": {"K": 1, "k": None}}, {"zz": 1, "u": {"k": 2.5}, "B": True}, {"b": 2, "early": [1, "2"]}]
    write(tmp_path, {"l.jsonl": "\n".join(map(json.dumps, lines)) + "\n", "a.json": json.dumps(lines)})
    tables, _ = load(spark, tmp_path)
    for name in ("l", "a"):
        assert tables[name].columns == ["b", "a", "a_1", "u_k", "u_k_1", "zz", "b_1", "early"]
        assert values(tables[name])[2] == (0, 0, "", 0, 2.5, 1, True, [])
        assert values(tables[name])[3][7] == ["1", "2"]


def test_types_of_mixed_values(spark):
    rows = ['{"a": 1, "b": 1, "c": {"x": 1}, "d": [], "e": 12345678901234567890, "f": null}', '{"a": 2.5, "b": "t", "c": "s", "d": [{"k": 1}], "e": 1}', '{"d": [{"j": "q"}]}']
    frame = spark.createDataFrame([("f", 0, i, t) for i, t in enumerate(rows)], "file string, split long, place long, text string")
    found = json_records.table(frame)
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields[:-1]}
    assert kinds == {"a": "double", "b": "string", "c": "string", "d": "array<struct<k:bigint,j:string>>", "e": "decimal(38,0)", "f": "string"}
    got = found.orderBy("__file_order").collect()
    assert [r["c"] for r in got] == ['{"x":1}', "s", None] and [r["b"] for r in got] == ["1", "t", None] and int(got[0]["e"]) == 12345678901234567890
    with pytest.raises(ValueError):
        json_records.table(spark.createDataFrame([("f", 0, 0, "[1]")], frame.schema))


def test_encodings_of_delimited_and_json_files(spark, tmp_path):
    text, wide = "name,note\nZoë,“€5” – ok\nÿ,…\n", 'name,note\nZoë,"a\nb"\n日本,ऊ੊\n'
    doc = json.dumps([{"Größe": "é", "n": 1}], ensure_ascii=False)
    lines = '{"a": "ä"}\n{"a": "ö"}\n'
    write(
        tmp_path,
        {
            "win.csv": text.encode("cp1252"), "latin.csv": "a,b\né\x80,x\x81\n".encode("latin-1"), "le.csv": b"\xff\xfe" + wide.encode("utf-16-le"),
            "be.txt": b"\xfe\xff" + wide.replace("\n", "\r\n").encode("utf-16-be"), "doc.json": doc.encode("latin-1"), "le.json": b"\xff\xfe" + doc.encode("utf-16-le"),
            "win.jsonl": lines.replace("ö", "€").encode("cp1252"), "be.jsonl": b"\xfe\xff" + lines.encode("utf-16-be"), "bom.json": b"\xef\xbb\xbf" + doc.encode(),
        },
    )
    tables, manifest = load(spark, tmp_path)
    assert {k: r["errors"] for k, r in manifest.items() if r["errors"]} == {}
    assert {r["path"].rsplit("/", 1)[1]: r["encoding"] for r in manifest.values()} == {
        "win.csv": "cp1252", "latin.csv": "latin-1", "le.csv": "utf-16", "be.txt": "utf-16", "doc.json": "latin-1", "le.json": "utf-16",
        "win.jsonl": "cp1252", "be.jsonl": "utf-16", "bom.json": "utf-8",
    }
    by_file = {r["path"].rsplit("/", 1)[1]: values(tables[k]) for k, r in manifest.items()}
    assert by_file["win.csv"] == [("Zoë", "“€5” – ok"), ("ÿ", "…")]
    assert by_file["latin.csv"] == [("é\x80", "x\x81")]
    assert by_file["le.csv"] == [("Zoë", "a\nb"), ("日本", "ऊ੊")]
    assert [(a, b.replace("\r\n", "\n")) for a, b in by_file["be.txt"]] == by_file["le.csv"]
    assert by_file["doc.json"] == by_file["le.json"] == by_file["bom.json"] == [("é", 1)]
    assert by_file["win.jsonl"] == [("ä",), ("€",)] and by_file["be.jsonl"] == [("ä",), ("ö",)]


def test_parts_with_unlike_headers_and_encodings(spark, tmp_path):
    write(
        tmp_path,
        {
            "t.csv/1.csv": "a,b\n1,x\n", "t.csv/2.csv": "b,a\ny,2\n", "t.csv/3.csv": "a,c\n3,new\n", "t.csv/4.csv": "b,a\n“,4\n".encode("cp1252"),
            "t.csv/5.csv": "a,b\n5,é\n", "t.csv/6 +.csv": 'b,a\n"q\nr",6\n', "t.csv/7.csv": "",
        },
    )
    tables, manifest = load(spark, tmp_path)
    assert tables["t"].columns == ["a", "b", "c"] and manifest["t"]["errors"] == []
    assert values(tables["t"]) == [(1, "x", ""), (2, "y", ""), (3, "", "new"), (4, "“", ""), (5, "é", ""), (6, "q\nr", "")]


def test_no_name_is_the_engines_own(spark, tmp_path):
    body = '{"__order": 1, "__first": "a", "__item": 1, "__part": 1, "__at": 1, "__file_order": 1, "__row_id": 1}\n'
    write(tmp_path, {"own.jsonl": body + body.replace('"__order": 1', '"__order": 2'), "c.csv": "_c1,x\n1,2\n"})
    tables, _ = load(spark, tmp_path)
    assert tables["own"].columns == ["order", "first", "item", "part", "at", "file_order", "row_id"] and tables["own"].n_rows == 2
    assert tables["c"].columns == ["c1", "x"]
    with pytest.raises(ValueError):
        number_rows(spark.createDataFrame([(1, 2)], "__at int, x int"), ["x"])


def test_manifest_names_the_tables(spark, tmp_path):
    write(tmp_path, {"My A.csv": "a\n1\n", "my_a.csv": "a\n2\n", "my_a.json": '[{"a": 3}]'})
    tables, manifest = load(spark, tmp_path)
    assert set(tables) == set(manifest) == {"my_a", "my_a_1", "my_a_2"}
