"""Stored tables: with and without a configured folder, and released."""

import os
import time

import pytest

from rowquarry import session
from rowquarry.operators import clean, profile
from rowquarry.operators.rows import number_rows
from rowquarry.session import materialise, passing, scratch, side_by_side, stored

SF = "/root/testdata/sf0.001"


class Unset:
    """A session's settings without the folder."""

    def __init__(self, conf):
        self.conf = conf

    def get(self, key, default=None):
        return default if key == "spark.checkpoint.dir" else self.conf.get(key, default)


class Bare:
    def __init__(self, spark):
        self.conf, self.sparkContext = Unset(spark.conf), spark.sparkContext


def test_a_local_session_without_a_folder(spark):
    first, second = (session.scratch_path(Bare(spark), "t") for _ in range(2))
    assert os.path.dirname(first) == os.path.dirname(second) and os.path.isdir(os.path.dirname(first)) and first != second


def test_a_cluster_without_a_folder_is_an_error(spark):
    class Context:
        master, applicationId = "yarn", "a"

    cluster = Bare(spark)
    cluster.sparkContext = Context
    with pytest.raises(RuntimeError):
        session.scratch_path(cluster, "t")


def local(path):
    return path.removeprefix("file:").replace("///", "/")


def test_a_scope_is_empty_after_it_ends(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    with scratch(spark) as folder:
        numbered = clean.clean_numbered(orders, ["o_orderkey"])
        profile.profile(numbered).collect()
        side_by_side([lambda k=k: materialise(spark.range(k), "side") for k in (3, 4)])
        assert len(os.listdir(local(folder))) >= 3
    assert not os.path.exists(local(folder))


def test_a_scope_is_empty_after_a_failure(spark):
    with pytest.raises(ZeroDivisionError), scratch(spark) as folder:
        materialise(spark.range(3), "kept")
        with scratch(spark) as inner:
            materialise(spark.range(3), "inner")
            assert inner.startswith(folder)
        assert not os.path.exists(local(inner)) and os.path.exists(local(folder))
        raise ZeroDivisionError
    assert not os.path.exists(local(folder))


def test_stored_results_outlive_their_steps(spark):
    with scratch(spark) as folder:
        rows = stored(spark, "numbered", lambda: number_rows(spark.range(50), ["id"]).rows)
        assert rows.count() == 50 and [n for n in os.listdir(local(folder)) if "steps" in n] == []
        with pytest.raises(ValueError):
            stored(spark, "failed", lambda: number_rows(materialise(spark.range(5), "step").withColumnRenamed("id", "__at"), ["__at"]).rows)
        assert [n.split("-")[0] for n in os.listdir(local(folder))] == ["numbered"]


def shuffle_files(spark):
    """The shuffle files on disk with their sizes."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle_")}


def test_shuffles_go_when_what_they_make_is_stored(spark):
    setting = spark.conf.get(session.CLEANUP, None)
    once = spark.range(20_000).repartition(3, "id")
    for build in (lambda: materialise(once, "t"), lambda: stored(spark, "t", lambda: once), lambda: number_rows(once, ["id"]).rows):
        before = shuffle_files(spark)
        rows = build()
        for _ in range(50):  # executors delete files in their own time
            left = sum(n for name, n in shuffle_files(spark).items() if name not in before)
            if left < 10_000:  # a count of each partition is not stored
                break
            time.sleep(0.2)
        assert left < 10_000 and rows.count() == 20_000
    assert spark.conf.get(session.CLEANUP, None) == setting
    side_by_side([lambda: materialise(once, "t")] * 4)
    assert spark.conf.get(session.CLEANUP, None) == setting and once.collect() == once.collect()


def test_what_passes_is_deleted_also_after_a_failure(spark):
    with scratch(spark) as folder:
        with passing(spark.range(5), "t") as rows:
            assert rows.count() == 5 and len(os.listdir(local(folder))) == 1
        assert os.listdir(local(folder)) == []
        with pytest.raises(ZeroDivisionError), passing(spark.range(5), "t"):
            raise ZeroDivisionError
        assert os.listdir(local(folder)) == []
