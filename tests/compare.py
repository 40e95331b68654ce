"""Run registered queries beside their DuckDB SQL.

    python tests/compare.py /root/testdata/sf0.01 QC2 WIN4
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def spark_result(spark, fn, sf):
    df = fn(spark, sf)
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def duck_result(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return canonical(columns, cur.fetchall())


def difference(got, expected):
    """None when equal, else a short description."""
    if got[0] != expected[0]:
        return f"columns {got[0]} != {expected[0]}"
    if len(got[1]) != len(expected[1]):
        return f"{len(got[1])} rows != {len(expected[1])}"
    bad = [(a, b) for a, b in zip(got[1], expected[1]) if a != b]
    return f"{len(bad)} of {len(got[1])} rows differ, first {bad[0]}" if bad else None


def main() -> None:
    import __spark_entry__ as entry
    from session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    queries, oracle = entry.queries(), entry.oracle_sql()
    failures = 0
    for name in names or queries:
        start = time.time()
        try:
            got = spark_result(spark, queries[name], sf)
            took = time.time() - start
            problem = difference(got, duck_result(oracle[name], sf)) if name in oracle else None
        except Exception as error:  # report and go on with the next query
            took, problem, got = time.time() - start, f"{type(error).__name__}: {str(error)[:600]}", ((), ())
        failures += problem is not None
        kind = "sql" if name in oracle else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28s} {kind:4s} {len(got[1]):7d} rows {took:6.2f} s {problem or ''}", flush=True)
        spark.catalog.clearCache()
    print(f"{failures} failures")


if __name__ == "__main__":
    main()
