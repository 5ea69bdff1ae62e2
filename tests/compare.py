"""Run registered queries against their SQL and report differences."""

from __future__ import annotations

import glob
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, Decimal):
        return format(value, "f")
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, connection, run, sql, sf_dir) -> str | None:
    """None if both results are equal as bags of rows, else what differs."""
    df = run(spark, sf_dir)
    relation = connection.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    ours = _rows(df.columns, df.collect())
    theirs = _rows(relation.columns, relation.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for mine, other in zip(ours, theirs):
        if mine != other:
            return f"{mine} != {other}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tarnlake.session import build_session

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    session = build_session("compare", cpus=8)
    session.sparkContext.setLogLevel("ERROR")
    database = connect(folder)
    oracles = entry.oracle_sql()
    failures = 0
    for name, run in entry.queries().items():
        if len(sys.argv) > 1 and name not in sys.argv[1:]:
            continue
        started = time.time()
        try:
            if name in oracles:
                found = difference(session, database, run, oracles[name], folder)
            else:
                found = None
                print(name, "rows only:", run(session, folder).count())
        except Exception as problem:  # report and go on with the next query
            found = f"{type(problem).__name__}: {str(problem)[:600]}"
        failures += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - started:.1f}s {found or ''}", flush=True)
    print("failures:", failures)
