"""Run registered queries on Spark and their oracle SQL on DuckDB, and compare all rows.

    python tests/compare.py [name ...]

SF_DIR names the folder.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    if hasattr(value, "isoformat"):
        return str(value)[:26]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(normal(row[i]) for i in order) for row in rows]
    return sorted(table, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) if not isinstance(v, (int, float)) else (v is None, "n", v) for v in r))


def compare(spark, folder, name, build, sql):
    start = time.perf_counter()
    frame = build(spark, folder)
    got_columns, got = frame.columns, [tuple(r) for r in frame.collect()]
    took = time.perf_counter() - start
    if sql is None:
        return True, f"{len(got)} rows (no oracle)", took
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    cursor = con.execute(sql)
    want_columns, want = [d[0] for d in cursor.description], cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return False, f"columns {sorted(got_columns)} != {sorted(want_columns)}", took
    a, b = rows_of(got_columns, got), rows_of(want_columns, want)
    if a == b:
        return True, f"{len(a)} rows", took
    different = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"rows {len(a)} vs {len(b)}; {sorted(got_columns)}; first differences {different}", took


def main(names):
    from __spark_entry__ import oracle_sql, queries
    from panelspark.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    every, oracles = queries(), oracle_sql()
    failed = 0
    for name in names or every:
        try:
            ok, text, took = compare(spark, folder, name, every[name], oracles.get(name))
        except Exception as error:  # report and go on with the next query
            ok, text, took = False, f"{type(error).__name__}: {str(error)[:900]}", 0.0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {took:6.2f}s {name}: {text}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
