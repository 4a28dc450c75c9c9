"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rowquarry.llm import caps, langid, licenses, minhash, mixing, packing, passages, placement, quality, rules, texts
from rowquarry.llm.components import components
from rowquarry.llm.suffixes import common_prefixes, suffix_array
from rowquarry.session import materialise, ship_package

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i}" for i in range(60))
EN = "the house and the garden with that of them is this was for you are not but have they"
FR = "la maison et le jardin avec cela qui est pour vous dans une mais ils sont pas des que sur"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def corpus(spark):
    """Ids, texts, languages and sources with every odd case, and a column whose name an operator also uses."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        lang, pool = ("en", EN) if i % 2 else ("fr", FR)
        words = rng.choice(pool.split(), rng.integers(12, 60))
        rows.append((i, " ".join(words) + ("\n" + BASE if i % 10 == 0 else ""), lang, f"s{i % 3}", i))
    rows += [
        (200, None, "en", "s0", 0), (201, "", "en", None, 0), (202, "1234 !!", None, "s1", 0), (203, BASE, "en", "s0", 0),
        (203, BASE, "en", "s0", 0), (204, BASE.upper() + " tail", "en", "s1", 0), (205, "word " * 30_000, "en", "s2", 0),
        (206, "Licensed under the Apache License, Version 2.0.\nmore", "en", "s2", 0), (207, "é" * 90 + BASE + "é", "fr", "s2", 0),
        (None, BASE + " x", "en", "s0", 0), (208, "a", "en", "s0", 0), (209, " \t\n", "en", "s0", 0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")


def words_of(text):
    return WORD.findall(text or "")


def test_suffix_arrays_are_sorted():
    rng = np.random.default_rng(0)
    for trial in range(300):
        text = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 70)), 0)
        if trial % 3 == 0:
            text = np.append(np.tile(text[:-1], 3), 0)
        sa = suffix_array(text)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        shared = common_prefixes(text, sa)
        for a, b in zip(sa, sa[1:]):
            n = 0
            while a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert shared[b] == n


def test_components(spark):
    pairs = [(5, 1), (1, 9), (9, 12), (20, 21), (30, 30), (40, 41), (41, 42), (42, 43), (43, 40)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(components(spark.createDataFrame(pairs, "a long, b long")).collect())
    assert got[12] == 1 and got[9] == 1 and got[21] == 20 and got[43] == 40 and got[140] == 100 and 30 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def linked(sets, percent):
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, words, percent):
    docs = corpus(spark)
    sets = {}
    for row in docs.filter("doc_id is not null").collect():
        w = words_of((row["text"] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[row["doc_id"]] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    want = linked(sets, percent)
    got = minhash.near_duplicates(docs, words=words, percent=percent).collect()
    assert len(got) == docs.count()
    for row in got:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        else:
            assert (row["n_shingles"], row["component_id"]) == (len(sets[row["doc_id"]]), want[row["doc_id"]])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    kept = minhash.keep_one(docs, words=words, percent=percent)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(i for i in sets if want[i] == i)


def test_star_of_near_copies_needs_every_link(spark):
    """Copies that are near the base and not near each other hang together by it alone."""
    base = [f"b{i}" for i in range(300)]
    rows = [(1000, " ".join(base))]
    for k in range(30):
        own = list(base)
        for j in range(7):
            own[(k * 9 + j * 41) % 300] = f"x{k}_{j}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(298)} for i, t in rows}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, words=3, percent=85).collect()}
    assert got == linked(sets, 85)


def test_passages(spark):
    docs = corpus(spark).union(spark.createDataFrame([(300, "q" + "ab" * 300, "en", "s", 0), (301, BASE[:99], "en", "s", 0)], corpus(spark).schema))
    seen, want = set(), {}
    rows = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in docs.collect() if r["text"]})
    for none, i, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        left = bytes(x for x, g in zip(data, gone) if not g)
        want[None if none else i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest())
    empty = (0, 0, 0, hashlib.sha256(b"").hexdigest())
    for shard in (8192, 8):  # the small one salts
        found, spans = passages.repeated_spans(docs, shard=shard)
        assert spans.count() == sum(1 for w in want.values() if w[1])
    for row in passages.digests(docs).collect():
        assert tuple(row)[1:] == want.get(row["doc_id"], empty)
    assert passages.digests(docs.limit(0)).count() == 0
    left = {r["doc_id"]: r["text"] for r in passages.remove_repeats(docs).collect()}
    assert left[200] is None and len(left) == len({r["doc_id"] for r in docs.collect()})


def test_salted_passages_agree(spark):
    """One passage in very many surroundings: a shard of few stretches must find what one large shard finds."""
    middle = "x".join(str(i * 7919) for i in range(60))
    rows = [(i, hashlib.sha256(str(i).encode()).hexdigest() * 2 + middle + hashlib.md5(str(i).encode()).hexdigest() * 4) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = [{r["doc"]: bytes(r["spans"]) for r in passages.repeated_spans(docs, shard=s)[1].collect()} for s in (8192, 16)]
    assert spans[0] == spans[1] and len(spans[0]) >= 149


def test_rules_counts_and_outliers(spark):
    docs = corpus(spark)
    got = rules.judge(docs, ["doc_id"]).collect()
    by_id = {r["doc_id"]: r for r in docs.collect()}
    assert len(got) == docs.count()
    for row in got:
        text = by_id[row["doc_id"]]["text"] or ""
        w, lines, again = words_of(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                again += line in lines
                lines.add(line)
        count = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if count[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered))
        assert tuple(row[c] for c in rules.COUNTS) == want
        assert row["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (row["base_failed"] and row["kept"])
    assert rules.judge(docs.limit(0), ["doc_id"]).count() == 0


def test_outliers_leave_clean_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice([f"t{k}" for k in range(400)], rng.integers(20, 300))), "en", "a") for i in range(300)]
    rows += [(1000 + i, " ".join(f"{w}$$$" for w in rng.choice([f"t{k}" for k in range(400)], 80)), "en", "a") for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).collect()}
    assert all(got[i] for i in range(300)) and not any(got[1000 + i] for i in range(20))


def test_language(spark):
    docs = corpus(spark)
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    assert model.languages == ["en", "fr"]
    assert np.mean([got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(120) if i % 10]) > 0.97
    for i in (200, 201, 202, 209):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert langid.recognised(docs, model).columns == docs.columns
    nothing = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def test_quality(spark):
    docs = corpus(spark).filter("doc_id < 150").unionByName(
        spark.createDataFrame([(500 + i, f"BUY!! NOW!! {i}$$$ !!! " * (5 + i % 7), "en", "s", 0) for i in range(60)], corpus(spark).schema)
    )
    labels = docs.selectExpr("doc_id", "if(doc_id < 150, 1, 0) quality").unionByName(spark.createDataFrame([(None, 1), (3, 0)], "doc_id long, quality int"))
    model = quality.fit(docs.filter("doc_id % 3 <> 1"), labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(corpus(spark).unionByName(docs), model, ["doc_id"]).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and {200, 201, None} <= set(got)
    away = [i for i in got if i is not None and i % 3 == 1 and (i < 120 or i >= 500)]
    assert np.mean([(got[i] >= 0.5) == (i < 150) for i in away]) > 0.97
    one = quality.fit(docs, labels.filter("quality = 1"))
    assert {round(r["score"], 6) for r in quality.score(docs, one, ["doc_id"]).collect()} == {1.0}
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none, ["doc_id"]).collect()} == {0.5}


def test_mixing(spark):
    docs = corpus(spark)
    sized = materialise(mixing.sizes(docs, ["doc_id", "source"]), "t")
    first, second = (sorted(map(tuple, mixing.mix(sized).collect()), key=repr) for _ in range(2))
    assert first == second and len(first) == docs.count()
    text = defaultdict(list)
    for r in docs.collect():
        text[r["doc_id"]].append(len(words_of(r["text"])))
    taken, size, aim = Counter(), Counter(), {}
    for r in mixing.mix(sized).collect():
        assert r["size"] in text[r["doc_id"]] and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        aim[r["source"]] = r["target"]
    assert sum(aim.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in size:
        assert aim[s] <= 2 * size[s] + 1e-6
        if s != "s2":  # one document holds nearly all of its words: no choice comes nearer than all others twice
            assert abs(taken[s] - aim[s]) <= 1
    assert taken["s2"] == 2 * size["s2"] - 30_000
    assert mixing.mix(sized.limit(0)).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_fill_is_exact_where_sums_reach():
    rng = np.random.default_rng(9)
    for _ in range(200):
        lengths = rng.choice(np.arange(1, 40), rng.integers(1, 8), replace=False)
        counts = rng.integers(1, 6, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 1))
        taken = mixing.fill(lengths, counts, budget)
        assert (taken <= counts).all() and (taken >= 0).all()
        sums = {0}
        for length, n in zip(lengths, counts):
            sums = {s + k * int(length) for s in sums for k in range(n + 1)}
        best = max(s for s in sums if s <= budget)
        got = int((lengths * taken).sum())
        assert got <= budget and best - got <= int(lengths.max())


def test_crowded_lengths_are_dealt_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    sized = spark.range(1000).selectExpr("id doc_id", "'a' source", "7L size").unionByName(spark.range(1000, 1300).selectExpr("id doc_id", "'b' source", "3L size"))
    got = mixing.mix(materialise(sized, "t")).groupBy("source").sum("taken").collect()
    aim = mixing.targets({"a": 7000, "b": 900})
    for r in got:
        assert abs(r[1] - aim[r["source"]]) < 7


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = corpus(spark)
    model = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    model.encode_special_tokens = True
    want = []
    for r in docs.collect():
        ids = model.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) - (len(ids) - 1) // 2048 * 2048, len(ids) + 1, 2048)]
        want += [(r["doc_id"], p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = packing.pack_documents(docs).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(held) <= math.ceil(sum(w[3] for w in want) / 2048) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_added_tokens_in_texts_are_encoded_by_the_files_defaults(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    docs = ["a <|endoftext|> b", "a<|endoftext|>b c", "<|endoftext|>", "a <|endoftext| > b", "plain words"]
    want = {i: model.encode(t, add_special_tokens=False).ids + [0] for i, t in enumerate(docs)}
    got = packing.pack_documents(spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")).collect()
    assert want[0] == [64, 220, 50256, 275, 0]
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_holds_every_constraint(rule):
    lengths = np.random.default_rng(1).integers(1, 100, 500)
    capacity = packing.Capacity(tokens=128, documents=4, attention=9000, rule=rule)
    lengths = lengths[lengths**2 <= 9000]
    sequence, offset = packing.best_fit(lengths, capacity)
    for s in np.unique(sequence):
        own = lengths[sequence == s]
        assert own.sum() <= 128 and len(own) <= 4 and (own**2).sum() <= 9000
        assert sorted(offset[sequence == s])[0] == 0


def test_encoder_parts_equal_whole_texts():
    rng = np.random.default_rng(3)
    bits = [" ", "\n", "a", "B", "é", "1", "'s", "'", ".", ",", "!!", "$$$", "\t", "中", "_", "²", " ", "\x1c", "don", " \n", "  "]
    encode = packing.encoder(None)
    some = ["".join(rng.choice(bits, rng.integers(1, 25))) for _ in range(2000)]
    assert encode.many(some) == [encode.whole(t) for t in some]


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 16))
    near = x[:60] + 0.1 * rng.normal(size=(60, 16))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(200 + i, v.tolist(), i % 2) for i, v in enumerate(near)]
    hub = rng.normal(size=16)
    rows += [(400 + i, (hub + 0.12 * rng.normal(size=16)).tolist(), 1) for i in range(80)]
    odd = [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, x[0].tolist(), None), (604, [1.0, 2.0], 1), (605, [2.0, 4.0], 1), (0, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    live = [r for r in rows + odd if r[0] not in (600, 601, 602, 603)]
    n = len(live)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            u, v = np.array(live[a][1]), np.array(live[b][1])
            link[a, b] = a != b and len(u) == len(v) and live[a][2] == live[b][2] and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98
    parent = {r[0]: r[0] for r in live}
    for _ in range(n):
        for a, b in zip(*np.nonzero(link)):
            low = min(parent[live[a][0]], parent[live[b][0]])
            parent[live[a][0]] = parent[live[b][0]] = low
    want = sorted((r[0], int(link[k].sum()), parent[r[0]]) for k, r in enumerate(live)) + [(i, 0, i) for i in (600, 601, 602, 603)]
    for block in (512, 16):
        got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in caps.near_vectors(df, block=block).collect()]
        assert sorted(got) == sorted(want)
    assert caps.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("words", [1024, 2048])
def test_filters_of_many_words_miss_no_pair(words):
    codes = caps.codes_for(64, words, 0.98)
    rng = np.random.default_rng(words)
    assert caps.missed(*caps.pairs_at(0.98, 3000, 64, rng), words, codes) == 0
    narrow = np.zeros((2, 500, 64))
    narrow[:, :, :6] = caps.pairs_at(0.98, 500, 6, rng)  # all of a vector's length in few dimensions
    assert caps.missed(*narrow, words, codes) == 0


def test_vectors_of_two_dimensions(spark):
    angles = np.random.default_rng(4).uniform(0, 2 * np.pi, 300)
    rows = [(i, [float(np.cos(a)), float(np.sin(a))], 1) for i, a in enumerate(angles)]
    near = np.cos(angles[:, None] - angles) >= 0.98
    got = caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == {i: int(near[i].sum()) - 1 for i in range(300)}


def test_licences(spark):
    docs = corpus(spark).unionByName(
        spark.createDataFrame([(700, "the house and the garden. released under the mit license. with that of them", "en", "s", 0), (701, "all rights of the house reserved for you", "en", "s", 0)], corpus(spark).schema)
    )
    model = licenses.fit(docs)
    got = {r["doc_id"]: r for r in licenses.scan(docs, model, ["doc_id"]).collect()}
    assert got[206]["families"] == ["apache-2.0"] and got[700]["families"] == ["mit"] and got[701]["families"] == []
    assert all(got[i]["families"] == [] for i in range(120)) and got[200]["n_paragraphs"] == 0
    assert licenses.scan(docs.limit(0), model, ["doc_id"]).count() == 0


def test_placement(spark):
    names = ("a", "b", "c")
    table = placement.lookup_table(names, 31)
    orders = []
    for s in names:
        number = [int.from_bytes(hashlib.md5(f"{k}:{s}".encode()).digest()[:8], "big") for k in ("offset", "step")]
        orders.append([(number[0] % 31 + j * (number[1] % 30 + 1)) % 31 for j in range(31)])
    want: dict = {}
    while len(want) < 31:
        for k, order in enumerate(orders):
            free = [slot for slot in order if slot not in want]
            if free:
                want[free[0]] = k
    assert table.tolist() == [want[s] for s in range(31)]
    docs = corpus(spark)
    placed = placement.place(docs).collect()
    assert len(placed) == docs.count()
    full = placement.lookup_table()
    for r in placed:
        text = "\x00null" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(text.encode()).hexdigest()[:15], 16) % placement.SLOTS
        assert (r["slot"], r["shard"]) == (slot, placement.SHARDS[full[slot]])
    moved = np.mean(placement.lookup_table(placement.SHARDS[:-1]) != full)
    assert np.bincount(full).max() - np.bincount(full).min() <= 1 and moved < 0.1
    with pytest.raises(ValueError):
        placement.lookup_table(names, 30)


def test_pipeline_filters_take_effect(spark, tmp_path):
    import corpus_pipeline

    corpus(spark).drop("score").withColumn("n_chars", texts.F.length("text")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
    ids = {r["doc_id"] for r in docs.collect()}
    assert 200 not in ids and 202 not in ids and 1 in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.count() >= docs.count()


def test_encoder_forgets_and_goes_on():
    rng = np.random.default_rng(8)
    encode = packing.Encoder(__import__("public_tokenizers").path(packing.TOKENIZER))
    encode.table = packing.IdTable(64)  # forgets in every block
    bits = ["word", "Mot", "ñu", "×a", "é", "12", "'s", ",", "!!", "\n", "x" * 40, "<|endoftext|>"]
    some = [" ".join("".join(rng.choice(bits, rng.integers(1, 4))) for _ in range(rng.integers(0, 30))) for _ in range(300)]
    for low in range(0, len(some), 50):
        assert encode.many(some[low : low + 50]) == [encode.whole(t) for t in some[low : low + 50]]
    assert encode.many([]) == [] and encode.many([None, ""]) == [b"", b""]


WRAPPED = {
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:",
    "gpl-3.0": " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
    " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the"
    " Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
    "copyright notice and this permission notice appear in all copies.",
    "mit": "// SPDX-License-Identifier: MIT\nint main() { return 0; }",
}


def test_wrapped_notices_and_identifiers(spark):
    docs = corpus(spark)
    rows = [(800 + i, t, "en", "s", 0) for i, t in enumerate(WRAPPED.values())]
    rows += [(850, "SPDX-License-Identifier: Foo-2.0", "en", "s", 0), (851, None, "en", "s", 0), (852, " \n\n ", "en", "s", 0)]
    whole = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumnRenamed("score", "families")
    model = licenses.fit(whole)
    got = {r["doc_id"]: r for r in licenses.scan(whole, model, ["doc_id"]).collect()}
    assert {f: got[800 + i]["families"] for i, f in enumerate(WRAPPED)} == {f: [f] for f in WRAPPED}
    assert got[850]["families"] == [] and got[851]["n_paragraphs"] == got[852]["n_paragraphs"] == 0
    assert all(got[i]["families"] == [] for i in range(120))


def test_the_licence_threshold_by_brute_force(spark):
    docs = corpus(spark).coalesce(1)  # one block of texts: what it repeats counts once
    model = licenses.fit(docs)
    odds = {}
    for r in docs.collect():
        data = (r["text"] or "").encode()
        for way, (_, first, last, p, _) in enumerate(licenses._scored(np.frombuffer(data, np.uint8), np.array([0, len(data)]), model)):
            for o, a, b in zip(licenses._log_odds(p), first, last):
                if o < 0 or licenses._unlike(data[a:b].decode()):
                    odds[way, data[a:b]] = o
    least = math.log(model.least / (1 - model.least))
    assert sum(o >= least for o in odds.values()) <= licenses.FALSE_RATE * len(odds)
    assert least < 1e-9 or sum(o >= least - 40 / licenses.BINS for o in odds.values()) > licenses.FALSE_RATE * len(odds)


def test_licences_of_no_documents(spark):
    none = corpus(spark).limit(0)
    assert licenses.scan(none, licenses.fit(none), ["doc_id"]).count() == 0


def test_paragraphs_end_at_blank_lines():
    data = np.frombuffer(b"a\nb\n \t\nc d\n\n\ne", np.uint8)
    assert np.flatnonzero(licenses._blank_lines(data)).tolist() == [6, 11, 12]


def test_placement_keeps_the_users_columns(spark, tmp_path):
    rows = spark.createDataFrame([(i, "mine", f"s{i}") for i in range(400)] + [(None, "mine", "x")], "doc_id long, shard string, Slot string")
    placed = placement.place(rows)
    assert sorted(placed.columns) == ["Slot_given", "doc_id", "shard", "shard_given", "slot"]
    assert placed.filter("shard_given = 'mine'").count() == 401 and placed.filter("Slot_given = 's7' and doc_id = 7").count() == 1
    assert placement.place(rows.limit(0)).count() == 0
    path = str(tmp_path / "shards")
    placement.write_shards(rows, path, files_per_shard=3)
    back = spark.read.parquet(path)
    assert sorted(back.select("doc_id", "shard_given").collect(), key=str) == sorted(placed.select("doc_id", "shard_given").collect(), key=str)
    where = dict(placed.select("doc_id", "shard").collect())
    assert all(where[r["doc_id"]] == r["shard"] for r in back.collect())


def test_unlike_texts_of_one_id_stay(spark):
    docs = spark.createDataFrame([(1, BASE), (1, BASE), (1, "quite another text of its own"), (2, "third " * 9)], "doc_id long, text string")
    assert sorted(map(tuple, minhash.keep_one(docs).collect())) == sorted({(1, BASE), (1, "quite another text of its own"), (2, "third " * 9)})
