"""Bounded conversation memory, over a table and over a stream.

Messages are ``(conv_id, turn, role, text)``. For every user message the frame is the last
``size`` messages of its conversation, itself included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rowquarry.functions import fixed
from rowquarry.operators.rows import ROW_ID, number_rows
from rowquarry.session import list_names, materialise, scratch

MESSAGE_SCHEMA = "conv_id long, turn long, role string, text string"
FRAME_SCHEMA = "conv_id long, turn long, frame array<struct<role:string,text:string>>"
BLOCK_ROWS = 65_536


def conversation_frames(messages: DataFrame, size: int = fixed.MEMORY_MESSAGES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Frames of all user messages in a table. Runs the numbering jobs of ``number_rows``.

    Numbered by (conversation, turn), messages are cut into blocks and each block also gets
    the ``size - 1`` messages before it. A window then needs one block only, so a
    conversation holding a third of all messages is spread over many tasks.
    """
    found = _frames(messages.select("conv_id", "turn", "role", "text"), ["turn"], size, block_rows)
    return found.filter("role = 'user'").select("conv_id", "turn", "frame")


def _frames(messages: DataFrame, order: list[str], size: int, block_rows: int) -> DataFrame:
    """Every message with its frame. Messages of a conversation are in the order of the columns ``order``."""
    numbered = number_rows(messages, ["conv_id", *order]).rows
    block = F.floor(F.col(ROW_ID) / block_rows).cast("long")
    carried = F.col(ROW_ID) % block_rows >= block_rows - (size - 1)
    copies = F.when(carried, F.array(block, block + 1)).otherwise(F.array(block))
    placed = numbered.select(*messages.columns, ROW_ID, block.alias("home"), F.explode(copies).alias("block"))
    window = Window.partitionBy("block", "conv_id").orderBy(ROW_ID).rowsBetween(-(size - 1), 0)
    framed = placed.withColumn("frame", F.collect_list(F.struct("role", "text")).over(window))
    return framed.filter(F.col("home") == F.col("block")).select(*messages.columns, ROW_ID, "frame")


def memory_turns(messages: DataFrame, size: int = fixed.MEMORY_MESSAGES) -> DataFrame:
    """``(conv_id, memory_turns)``: question and answer pairs still remembered at the end."""
    return messages.groupBy("conv_id").agg(
        F.floor(F.least(F.count(F.lit(1)), F.lit(size)) / 2).cast("long").alias("memory_turns")
    )


def read_messages(
    spark: SparkSession, folder: str, pattern: str = "*", files_per_trigger: int | None = None
) -> DataFrame:
    """A message stream from the parquet files in a folder whose names match ``pattern``.
    ``files_per_trigger`` bounds a micro-batch, and with it the messages of one conversation
    that a task holds at a time."""
    reader = spark.readStream.schema(MESSAGE_SCHEMA).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def stream_frames(messages: DataFrame, size: int = fixed.MEMORY_MESSAGES, idle_timeout_ms: int | None = None) -> DataFrame:
    """The same frames from a stream, in append mode. State is at most ``size`` messages per
    conversation. Messages are taken in turn order within a micro-batch and as they come
    across batches. An idle conversation's state is dropped after the timeout, if given."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held: list[tuple[str, str]] = []
        if state.exists:
            roles, texts = state.get
            held = list(zip(roles, texts))
        arrived = pd.concat(list(batches)).sort_values("turn", kind="stable")
        turns, frames = [], []
        for turn, role, text in zip(arrived["turn"], arrived["role"], arrived["text"]):
            held = [*held, (role, text)][-size:]
            if role == "user":
                turns.append(turn)
                frames.append([{"role": r, "text": t} for r, t in held])
        state.update(([r for r, _ in held], [t for _, t in held]))
        if idle_timeout_ms is not None:
            state.setTimeoutDuration(idle_timeout_ms)
        yield pd.DataFrame({"conv_id": [key[0]] * len(turns), "turn": turns, "frame": frames})

    timeout = GroupStateTimeout.NoTimeout if idle_timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return messages.groupBy("conv_id").applyInPandasWithState(
        update, FRAME_SCHEMA, "roles array<string>, texts array<string>", "append", timeout
    )


def run_to_table(frames: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a frame stream over everything available now into parquet, and read the result."""
    query = (
        frames.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return frames.sparkSession.read.schema(frames.schema).parquet(path)


HELD_SCHEMA = "conv_id long, arrival long, turn long, role string, text string"
MERGE_EVERY = 16  # micro-batches whose states are read together before they are merged


def run_ordered(
    messages: DataFrame, path: str, checkpoint: str, size: int = fixed.MEMORY_MESSAGES, block_rows: int = BLOCK_ROWS, merge_every: int = MERGE_EVERY
) -> DataFrame:
    """Run a message stream over everything available now into parquet under ``path`` and read the frames.

    Every micro-batch is framed as a table: the messages that its conversations still remember, then its own, in the order
    (arrival, turn). So one conversation may hold most of a micro-batch, or of the stream, and is still spread over many
    tasks. A turn that comes late, in a later micro-batch than its successors, is appended where it arrives.

    What conversations remember is stored for those that a micro-batch touched, and merged every ``merge_every`` batches.
    Frames and state are written under the micro-batch's number, which a restarted stream writes over: each message counts once.
    """
    spark = messages.sparkSession

    def held_before(batch: int) -> DataFrame:
        """The newest state of every conversation before a micro-batch."""
        merged = (batch // merge_every) * merge_every
        parts = [f"{path}/state/{n}" for n in ([merged - 1] if merged else []) + list(range(merged, batch))]
        parts = [p for p in parts if "_SUCCESS" in list_names(spark, p)]
        if not parts:
            return spark.createDataFrame([], f"{HELD_SCHEMA}, batch long")
        held = spark.read.schema(f"{HELD_SCHEMA}, batch long").parquet(*parts)
        newest = held.groupBy("conv_id").agg(F.max("batch").alias("batch"))
        return held.join(newest, ["conv_id", "batch"]).select(*held.columns)

    def frame(batch: DataFrame, number: int) -> None:
        with scratch(spark, "stream"):
            own = materialise(batch.select("conv_id", F.lit(number).cast("long").alias("arrival"), "turn", "role", "text"), "batch")
            held = held_before(number).join(own.select("conv_id").distinct(), "conv_id", "left_semi").drop("batch")
            found = materialise(_frames(held.unionByName(own), ["arrival", "turn"], size, block_rows), "frames")
            new = found.filter((F.col("arrival") == number) & (F.col("role") == "user")).select("conv_id", "turn", "frame")
            new.write.mode("overwrite").parquet(f"{path}/frames/batch={number}")
            last = found.groupBy("conv_id").agg(F.max(ROW_ID).alias("last"))
            kept = found.join(last, "conv_id").filter(F.col(ROW_ID) > F.col("last") - size).select(*held.columns, F.lit(number).cast("long").alias("batch"))
            if (number + 1) % merge_every == 0:  # the state of all conversations so far
                rest = held_before(number).join(own.select("conv_id").distinct(), "conv_id", "left_anti")
                kept = kept.unionByName(rest)
            kept.write.mode("overwrite").parquet(f"{path}/state/{number}")

    query = messages.writeStream.foreachBatch(frame).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(FRAME_SCHEMA).parquet(f"{path}/frames")
