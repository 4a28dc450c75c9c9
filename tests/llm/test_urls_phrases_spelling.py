"""URL filters, phrase collocations and spelling variants against brute force, with every odd row."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowquarry.llm import phrases, queries, spelling, urls
from rowquarry.session import ship_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# --- URL filters -------------------------------------------------------------------------------------------


def placed(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (lowered(found[1]), found[2]) if found else ("", "")


def judged(url, listed, rules=urls.RULES):
    host, path = placed(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: (len(r.host + r.path), len(r.host)))
        return host, path, best.host + best.path, best.verdict
    return host, path, None, "block" if host and (host in listed or host + path in listed) else "allow"


URLS = [
    None, "", "no scheme", "http://", "http:///x", "HTTP://A.Example.ORG/es/1", "https://example.org", "https://badexample.org/es/",
    "https://example.org/en/12?x=http://b.com/", "https://example.org/en/2", "https://m.example.com/fr/9#top", "https://example.com/de/",
    "https://com/de/x", "http://a.net/1", "http://a.net/1", "http://a.net/2\n3", "http://ä.net/é", "http://u@h.net:80/p", "a://b://c/d", "x://y.net?q#z",
]


def test_urls_by_rules_and_list(spark):
    many = URLS + [f"http://h{i % 50}.net/p/{i}" for i in range(3000)]
    listed = {f"h{i}.net" for i in range(0, 50, 7)} | {f"h{i % 50}.net/p/{i}" for i in range(0, 3000, 11)} | {"a.net/1", "not/there", "", "ä.net/é", "x://"}
    pages = spark.createDataFrame([(i, u, "mine", "mine") for i, u in enumerate(many)], "page_id long, url string, verdict string, key string")
    keys = spark.createDataFrame([(k,) for k in sorted(listed)] + [(None,), ("a.net/1",)], "key string")
    want = sorted((i, *judged(u, listed)) for i, u in enumerate(many))
    for bits in (urls.MAX_BITS, 1500):  # one segment and several
        got = urls.judge(pages, keys, keep=("page_id", "verdict"), max_bits=bits)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert {r[3] for r in want} >= {None, "org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"}


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 9 == 0).alias("listed")).cache()
    levels = urls.cascade(keys)
    assert len(levels) > 2
    assert keys.filter(urls.member(levels, F.col("key")) != F.col("listed")).count() == 0
    assert urls.cascade(keys.filter("NOT listed")) == []


def test_no_urls_and_no_list(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    keys = spark.createDataFrame([], "key string")
    assert urls.judge(none, keys).collect() == []
    some = spark.createDataFrame([(None, "http://a.net/1"), (1, None)], none.schema)
    assert sorted(map(tuple, urls.judge(some, keys).collect()), key=str) == [(1, "", "", None, "allow"), (None, "a.net", "/1", None, "allow")]


def test_urls_run_without_python_or_join(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    keys = pages.select(F.concat(*urls.host_and_path(F.col("url"))).alias("key")).filter("page_id % 3 = 0")
    plan = urls.judge(pages, keys)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Join", plan)


# --- phrases -----------------------------------------------------------------------------------------------


def counted(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + s])) for s in (1, 2, 3) for i in range(len(w) - s + 1))
    return f, n


def best_phrases(rows, top=2000):
    f, n = counted(rows)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 10}
    longer = defaultdict(int)
    for (lang, w), a in candidates.items():
        for s in range(2, len(w)):
            for i in range(len(w) - s + 1):
                longer[lang, w[i : i + s]] = max(longer[lang, w[i : i + s]], a)
    by_lang = defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * longer[lang, w] >= 50 * a:
            continue
        cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        by_lang[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in by_lang.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])
    }


def chatter(seed=3):
    rng = np.random.default_rng(seed)
    pool = [*"a b c d e f g h".split(), "New", "York", "city", "é", "ÉA", "a.b", "x\u00a0y", "--"]
    rows = []
    for i in range(200):
        words = rng.choice(pool, rng.integers(1, 80), p=None)
        text = "".join(w + rng.choice([" ", "  ", "\t", ". ", "\n", " , "], p=[0.8, 0.05, 0.05, 0.04, 0.03, 0.03]) for w in words)
        rows.append((["en", "fr", None][i % 3], text + (" new york city" if i % 2 else "")))
    rows += [("en", None), (None, ""), ("en", " \t "), ("en", "the hot pair " * 20_000), ("fr", "lone"), ("und", "new york city " * 12)]
    return rows + rows[:3]


def test_phrases_by_brute_force(spark):
    rows = chatter()
    frame = spark.createDataFrame([(lang, text, "mine", 1) for lang, text in rows], "lang string, text string, phrase string, score long")
    want = best_phrases(rows)
    for parts in (1, 7):
        got = phrases.collocations(frame.repartition(parts))
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert set(map(tuple, got.collect())) == want
    assert {"en", "fr", "und"} == {r[0] for r in want} and any(len(r[2].split(" ")) == 3 for r in want)
    assert set(map(tuple, phrases.collocations(frame, top=3).collect())) == best_phrases(rows, 3)


def test_longer_phrases_and_many_routes(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ROUTE_BYTES", 500)
    monkeypatch.setattr(phrases, "MAX_BITS", 1 << 13)
    rows = chatter(5)[:150]
    frame = spark.createDataFrame(rows, "lang string, text string")
    got = Counter()
    for r in phrases.counts(frame, longest=4).collect():
        got[r["lang"], r["depth"], r["phrase"]] += r["f"]
    f = Counter()
    total = Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang, 0, ""] += len(w)
            f.update((lang, s, " ".join(w[i : i + s])) for s in (1, 2, 3, 4) for i in range(len(w) - s + 1))
    assert got == Counter({k: a for k, a in f.items() if a >= 10}) + total


def test_exact_scores_beyond_64_bits(spark):
    big = 3_000_000_001
    row = spark.createDataFrame([(big, big + 7, big + 11)], "a long, l long, r long")
    wide = "CAST({} AS DECIMAL(15, 0))".format
    got = row.selectExpr(f"({wide('a')} * {wide('a')} * CAST(1000000 AS DECIMAL(7, 0))) div ({wide('l')} * {wide('r')}) AS s").first()["s"]
    assert got == 1_000_000 * big * big // ((big + 7) * (big + 11))


def test_no_phrases(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).collect() == []


def test_equal_partitions():
    rng = np.random.default_rng(1)
    for _ in range(200):
        depth, n = int(rng.integers(1, 5)), int(rng.integers(1, 90))
        symbols = rng.integers(0, rng.integers(1, 7), (depth, n))
        order, starts = phrases.multikey_quicksort(symbols)
        ends = [*starts[1:], n]
        assert all((symbols[:, order[a:b]] == symbols[:, order[[a]]]).all() for a, b in zip(starts, ends))
        assert sorted((tuple(symbols[:, order[a]]), b - a) for a, b in zip(starts, ends)) == sorted(Counter(map(tuple, symbols.T)).items())


# --- spelling ----------------------------------------------------------------------------------------------


def vocabulary(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if c >= 5 and len(w) >= 6}


def one_change(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def grouped(rows):
    n, out = vocabulary(rows), {}
    for w in n:
        near = [x for x in n if one_change(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 5 * n[w] else None, len(near))
    found = set()
    for w, (form, n_near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        found.add((w, form, root, n[w], n_near, n.get(form)))
    return found


def test_spelling_by_brute_force(spark):
    rng = np.random.default_rng(4)
    base = ["Garden", "gardén", "gardens", "retains", "stainer", "ÿÿÀßäö", "aaaaaa", "aaaaaaa", "aaaaaaaa", "gardeners", "a" * 40]
    rows = []
    for i in range(400):
        words = []
        for w in rng.choice(base, 30, p=[0.6, *[0.04] * 10]):
            if rng.random() < 0.25:
                k = int(rng.integers(len(w)))
                w = [w[:k] + w[k + 1 :], w[:k] + rng.choice([*"abeénz"]) + w[k:], w[:k] + rng.choice([*"abeénz"]) + w[k + 1 :]][rng.integers(3)]
            words.append(w)
        rows.append((i, "-".join(words)))
    rows += [(None, "garden garden"), (7, None), (8, ""), (9, "12 .. short"), (10, "thelongrun" * 3000), (11, "garden " * 5000), (11, "garden " * 5000)]
    frame = spark.createDataFrame([(i, t, "mine", "mine") for i, t in rows], "doc_id long, text string, word string, form string")
    got = spelling.variants(frame)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in got.collect()]
    want = grouped(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] and r[2] != r[1] for r in want), "a chain of two steps"


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "lonely words without any near ones " * 6)], "doc_id long, text string")).count() == 2


def test_letters_are_dealt_evenly(spark):
    words = spark.createDataFrame([("aaaaabbbbccd",)], "word string")
    assert spelling.deal_letters(words, 2) == ["ad", "bc"]


def test_registered_queries_have_their_columns(spark):
    assert queries.op11_url_filter(spark, SF).columns == ["page_id", "host", "path", "rule", "verdict"]
    assert queries.op12_collocations(spark, SF).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert queries.op13_spelling(spark, SF).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_sends_no_side_of_a_join_through_the_driver(spark, tmp_path):
    """The files of a few words are far below Spark's bound for a broadcast, their signatures and forms need not be."""
    spark.createDataFrame([("wording", 90), ("wordings", 9), ("warding", 8)], "word string, n long").write.parquet(str(tmp_path / "words"))
    pairs = spelling.near_pairs(spark.read.parquet(str(tmp_path / "words")))
    docs = spark.createDataFrame([(1, "wording " * 60 + "wordings " * 6)], "doc_id long, text string")
    for found in (pairs, spelling.variants(docs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r["word"], r["other"]) for r in pairs.collect()} == {("wording", "wordings"), ("wordings", "wording"), ("wording", "warding"), ("warding", "wording")}
