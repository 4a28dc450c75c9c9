import os
import random
from collections import deque

import pytest

from rowquarry.functions import fixed
from rowquarry.plans import retrieve
from rowquarry.session import scratch_path
from rowquarry.sources import index_io
from rowquarry.streaming import memory


def talk(seed=4):
    rng = random.Random(seed)
    sizes = {0: 400, **{i: rng.randint(1, 40) for i in range(1, 20)}}  # one conversation holds about half
    return [(c, t, "user" if t % 2 == 0 else "assistant", f"m{c}.{t}") for c, n in sizes.items() for t in range(n)]


def expected(messages, size):
    held, out = {}, {}
    for c, t, role, text in sorted(messages):
        queue = held.setdefault(c, deque(maxlen=size))
        queue.append((role, text))
        if role == "user":
            out[c, t] = list(queue)
    return out


def result(df):
    return {(r["conv_id"], r["turn"]): [(m["role"], m["text"]) for m in r["frame"]] for r in df.collect()}


@pytest.mark.parametrize("size,block", [(16, 65536), (16, 64), (4, 16), (1, 8)])
def test_frames_across_blocks(spark, size, block):
    messages = talk()
    df = spark.createDataFrame(messages, memory.MESSAGE_SCHEMA).repartition(6)
    assert result(memory.conversation_frames(df, size, block)) == expected(messages, size)


def test_stream_in_several_batches(spark, tmp_path):
    messages = talk()
    folder = tmp_path / "in"
    for part, keep in enumerate([lambda t: t < 7, lambda t: 7 <= t < 30, lambda t: t >= 30]):
        rows = [m for m in messages if keep(m[1])]
        spark.createDataFrame(rows, memory.MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"b{part}"))
    one = tmp_path / "flat"
    one.mkdir()
    for part in range(3):
        for file in (folder / f"b{part}").glob("*.parquet"):
            copy = one / f"{part}-{file.name}"
            copy.write_bytes(file.read_bytes())
            os.utime(copy, (1_700_000_000 + part, 1_700_000_000 + part))  # the file source goes by age
    stream = memory.stream_frames(memory.read_messages(spark, str(one), "*.parquet", files_per_trigger=1), size=16)
    got = memory.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert result(got) == expected(messages, 16)


def test_turns_are_capped(spark):
    df = spark.createDataFrame(talk(), memory.MESSAGE_SCHEMA)
    got = {r["conv_id"]: r["memory_turns"] for r in memory.memory_turns(df).collect()}
    assert got[0] == 8 and got[1] == min(16, sum(1 for m in talk() if m[0] == 1)) // 2


def test_contexts_from_a_written_index(spark):
    docs = spark.createDataFrame(
        [(i, f"row {i} apples {'green' if i % 2 else 'red'} w{i}", "row_window", "fruit") for i in range(40)],
        "doc_id long, text string, chunk_type string, table string",
    )
    path = scratch_path(spark, "test-index")
    index_io.write_index(docs, path)
    index = index_io.open_index(spark, path)
    asked = spark.createDataFrame([(1, "average of green apples w7"), (2, "hello w3"), (3, "")], "query_id long, text string")
    got = {r["query_id"]: r for r in retrieve.prompts(index, asked).collect()}
    assert got[1]["qtype"] == "analytical" and got[1]["context"].count("[Context ") == 8
    assert got[2]["context"].count("[Context ") == 6
    assert got[1]["context"].startswith("[Context 1 | type=row_window table=fruit]\nrow ")
    assert got[2]["prompt"].startswith("[Query type: conversational]\n\nRETRIEVED CONTEXT:\n[Context 1")
    assert got[2]["prompt"].endswith("\n\nUSER QUESTION: hello w3")
    assert got[3]["context"].count("[Context ") == 6  # no words, but vectors still answer
    none = spark.createDataFrame([], docs.schema)
    empty_path = scratch_path(spark, "test-index")
    index_io.write_index(none, empty_path)
    nothing = retrieve.contexts(index_io.open_index(spark, empty_path), asked).collect()
    assert {r["context"] for r in nothing} == {fixed.NO_CONTEXT}


def test_questions_from_completions(spark):
    texts = ['x ["A?", "B?"] y ["C?"]', "1. One?\n\t2) Two? \nnone", "nothing here", "[not json] why?", '["1?","2?","3?","4?","5?","6?"]', "[1, 2]", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["questions"] for r in retrieve.extract_questions(df).collect()}
    assert got[0] == ["A?", "B?"] and got[1] == ["One?", "Two?"] and got[2] == fixed.DEFAULT_QUESTIONS
    assert got[3] == ["[not json] why?"] and len(got[4]) == 5 and got[5] == ["1", "2"] and got[6] == fixed.DEFAULT_QUESTIONS
