"""Runs queries beside their SQL on DuckDB and compares all rows.

usage: python tests/check_oracles.py [folder] [key ...]
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from featlake.plans.derived import GIVEN  # noqa: E402
from featlake.session import local_session  # noqa: E402


def normal(value):
    if isinstance(value, float):
        return float(repr(value)) + 0.0
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder, key, build, sql):
    start = time.time()
    df = build(spark, folder)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return f"rows-only {len(got)} rows", took
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS differ: {sorted(df.columns)} != {sorted(columns)}", took
    left, right = rows_of(df.columns, got), rows_of(columns, expected)
    if left == right:
        return f"ok {len(left)} rows", took
    text = f"ROWS differ: {len(left)} != {len(right)}"
    gone, extra = [r for r in left if r not in set(right)][:2], [r for r in right if r not in set(left)][:2]
    return f"{text}\n   spark {gone}\n   sql   {extra}", took


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for key in argv[1:] or queries:
        try:
            text, took = compare(spark, con, folder, key, queries[key], oracles.get(key))
        except Exception as err:  # report every query, then fail
            text, took = "ERROR " + "".join(traceback.format_exception_only(err))[:1200], 0.0
        print(f"{key:28s} {took:6.2f}s {text}", flush=True)
        if not text.startswith(("ok", "rows-only")):
            bad.append(key)
    print(f"{len(bad)} bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
