"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from checks.compare import canonical
from checks.queries import REGISTERED

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")


def test_every_query_has_sql():
    assert {query.__name__ for query in REGISTERED} <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    base = duckdb.connect()
    for table in TABLES.split():
        base.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries()[name](spark, SF)
    answer = base.execute(oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, df.collect()) == canonical(columns, answer.fetchall())
