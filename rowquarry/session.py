"""Session settings, shared scratch space and size checks used by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from pathlib import Path
from threading import Lock
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Result = TypeVar("Result")
_FOLDER = Lock()

# A side is broadcast only after its measured size is under this bound.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rowquarry")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Texts can be long: what travels to a Python worker at once is bounded by bytes, not only by rows.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MAX_BATCH_BYTES = 8 * 1024 * 1024


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package's modules to the workers, once per application, so that a session started
    in any folder can run them, and bound the bytes of a batch if the session does not. Returns the session."""
    context = spark.sparkContext
    if not context.getConf().contains(BATCH_BYTES):
        spark.conf.set(BATCH_BYTES, str(MAX_BATCH_BYTES))
    with _FOLDER:
        if getattr(context, "_rowquarry_shipped", False):
            return spark
        root = Path(__file__).resolve().parent
        archive = os.path.join(tempfile.mkdtemp(prefix="rowquarry-"), "rowquarry.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for module in sorted(root.rglob("*.py")):
                out.write(module, module.relative_to(root.parent))
        context.addPyFile(archive)
        context._rowquarry_shipped = True
    return spark


# Folder of a local session without a configured one, by application.
_LOCAL_FOLDERS: dict[str, str] = {}
_SCOPE: ContextVar[str | None] = ContextVar("rowquarry-scope", default=None)


def _base_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    with _FOLDER:
        if context.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="rowquarry-")
        return _LOCAL_FOLDERS[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the cluster's checkpoint folder, inside the scope that is open, if one is.

    The folder is read from ``spark.checkpoint.dir``. Only a local session may fall back
    to a temporary folder; on a cluster an unset folder is an error, because executors
    could not share what they write.
    """
    return f"{_SCOPE.get() or _base_folder(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark uses; nothing happens if there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, by the file system that Spark uses; none if there is no folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(target)) if files.exists(target) else []


@contextmanager
def scratch(spark: SparkSession, label: str = "scope") -> Iterator[str]:
    """A scope: whatever is stored inside the block lies in one folder, which is deleted when the block ends, also by an
    error. What is read later must have been written elsewhere before. Scopes may be nested; yields the folder."""
    folder = scratch_path(spark, label)
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        delete_path(spark, folder)


COMPACT = "zstd"

# What is stored is read from its files, so nobody reads the shuffles again that made it. Spark keeps these until the driver
# happens to collect its garbage, unless this is set while a write is planned.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITES = Lock()
_WRITING: dict[int, list] = {}  # by session: how many writes run, and the setting before the first


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written inside the block go when it is written. The setting is the session's: it stays
    while any thread writes and is put back by the last one."""
    name = spark._jsparkSession.hashCode()
    with _WRITES:
        state = _WRITING.setdefault(name, [0, None])
        if not state[0]:
            state[1] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        state[0] += 1
    try:
        yield
    finally:
        with _WRITES:
            state[0] -= 1
            if not state[0]:
                del _WRITING[name]
                spark.conf.set(CLEANUP, state[1]) if state[1] is not None else spark.conf.unset(CLEANUP)


def _write(df: DataFrame, path: str, compression: str | None = None) -> None:
    with _shuffles_deleted(df.sparkSession):
        (df.write.option("compression", compression) if compression else df.write).parquet(path)


def stored(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build``, written to the enclosing scope. What ``build`` stores on its way is deleted afterwards."""
    path = scratch_path(spark, label)
    with scratch(spark, f"{label}-steps"):
        df = build()
        _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared parquet and read it back: later passes see the same rows,
    prune columns, and survive lost executors. Runs one job."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_compact(df: DataFrame, label: str) -> DataFrame:
    """``materialise`` for tables as large as the input, in smaller files."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    _write(df, path, COMPACT)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df``, written to shared parquet until the block ends: between two shuffles of whole rows, so that the files of the
    first are gone, and its work is not done again, when the second is made. Runs one job."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    try:
        _write(df, path, COMPACT)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        delete_path(spark, path)


def _field_bytes(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16)
    if isinstance(field.dataType, T.ArrayType):
        if isinstance(field.dataType.elementType, T.NumericType):
            return F.coalesce(F.size(column), F.lit(0)) * F.lit(8) + F.lit(16)
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + F.lit(16)
    if isinstance(field.dataType, (T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + F.lit(16)
    return F.lit(16)


def measured_size(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of ``df``. Runs one aggregate job."""
    width: Column = F.lit(0).cast("long")
    for field in df.schema.fields:
        width = width + _field_bytes(field)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return int(row["n"]), int(row["b"])


def fits_broadcast(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether ``df`` is proven small enough to broadcast. Runs one aggregate job."""
    return measured_size(df)[1] <= max_bytes


def side_by_side(calls: Iterable[Callable[[], Result]], at_once: int = 8) -> list[Result]:
    """Results of independent calls that each run Spark jobs, submitted from a few driver threads
    so that small jobs of one table fill the gaps of another's."""
    with ThreadPoolExecutor(at_once) as pool:
        # Each call sees the scope that is open here.
        return [future.result() for future in [pool.submit(copy_context().run, call) for call in calls]]
