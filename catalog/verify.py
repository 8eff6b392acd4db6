"""Run queries beside their SQL and compare rows: ``python -m catalog.verify [--sf DIR] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb


def normal(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, bool) or isinstance(v, str):
        return v
    try:
        return round(float(v), 6) + 0.0
    except (TypeError, ValueError):
        return str(v)


def compare(columns_a, rows_a, columns_b, rows_b) -> str:
    if sorted(columns_a) != sorted(columns_b):
        return f"columns differ: {sorted(columns_a)} / {sorted(columns_b)}"
    if len(rows_a) != len(rows_b):
        return f"row counts differ: {len(rows_a)} / {len(rows_b)}"
    order = sorted(columns_a)

    def ordered(columns, rows):
        at = [columns.index(c) for c in order]
        return sorted((tuple(normal(r[i]) for i in at) for r in rows), key=repr)

    for a, b in zip(ordered(list(columns_a), rows_a), ordered(list(columns_b), rows_b)):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(order, a, b) if x != y]
            return f"values differ: {str(diff)[:900]}"
    return ""


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    from catalog.base import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    from catalog import ORACLES, QUERIES

    folder = "/root/testdata/sf0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        folder = argv[at + 1]
        del argv[at : at + 2]
    spark = (
        SparkSession.builder.master(os.environ.get("VERIFY_MASTER", "local[8]"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in argv or list(QUERIES):
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            rows = df.collect()
            took = time.time() - start
            if name not in ORACLES:
                print(f"ROWS {name} {len(rows)} {took:.1f}s", flush=True)
                continue
            cur = con.execute(ORACLES[name])
            want, columns = cur.fetchall(), [c[0] for c in cur.description]
            problem = compare(df.columns, [tuple(r) for r in rows], columns, want)
        except Exception as e:  # noqa: BLE001
            took, problem = time.time() - start, f"{type(e).__name__}: {str(e)[:900]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok'} {name} {took:.1f}s {problem}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
