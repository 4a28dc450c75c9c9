"""Run registered queries against their SQL: ``python -m checks.compare SF_DIR [query …]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks import oracles, queries
from rowquarry.session import local_session


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, int):
        return float(value)
    return str(value)


def canonical(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main(sf: str, only: list[str]) -> int:
    spark = local_session(8)
    base = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        base.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    sql, failed = oracles.all_sql(), 0
    for query in queries.REGISTERED:
        name = query.__name__
        if only and name not in only:
            continue
        started = time.time()
        try:
            df = query(spark, sf)
            mine = canonical(df.columns, df.collect())
            took = time.time() - started
            if name not in sql:
                print(f"{name:28s} no SQL     {len(mine):7d} rows {took:6.1f}s", flush=True)
                continue
            started = time.time()
            answer = base.execute(sql[name])
            columns = [d[0] for d in answer.description]
            other = canonical(columns, answer.fetchall())
            sql_took = time.time() - started
            same = sorted(df.columns) == sorted(columns) and mine == other
            print(f"{name:28s} {'same' if same else 'DIFFERENT':9s} {len(mine):7d} rows {took:6.1f}s sql {sql_took:5.1f}s", flush=True)
            if not same:
                failed += 1
                print("   columns", sorted(df.columns), sorted(columns), len(mine), len(other))
                shown = 0
                for a, b in zip(mine, other):
                    if a != b and shown < 2:
                        shown += 1
                        print("   spark ", repr(a)[:700])
                        print("   duckdb", repr(b)[:700])
        except Exception as problem:  # report and go on to the next query
            failed += 1
            print(f"{name:28s} FAILED {str(problem)[:900]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
