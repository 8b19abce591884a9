"""Run registered queries on Spark and their SQL on DuckDB and compare the rows."""

from __future__ import annotations

import argparse
import math
import sys
import threading
import time

import duckdb
from pyspark.sql import SparkSession

from checks import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cpus: str = "8") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("linkloom-checks")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return db


def _cell(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return repr(value) if isinstance(value, str) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, db, name, folder) -> tuple[bool, str]:
    started = time.time()
    df = registry.queries()[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    found = db.execute(sql)
    columns = [d[0] for d in found.description]
    want = rows_of(columns, found.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        extra = sorted(set(got) - set(want))[:2]
        lack = sorted(set(want) - set(got))[:2]
        return False, f"{len(got)} rows vs {len(want)}\n   spark only {extra}\n   sql only   {lack}"
    return True, f"{len(got)} rows, {took:.1f}s"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("folder", nargs="?", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--limit", type=float, default=60, help="seconds before a query's jobs are cancelled")
    args = ap.parse_args()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    db = database(args.folder)
    bad = []
    names = [n for n in registry.queries() if any(p in n for p in args.only.split(","))]
    for name in names:
        watch = threading.Timer(args.limit, spark.sparkContext.cancelAllJobs)
        watch.start()
        started = time.time()
        try:
            good, note = compare(spark, db, name, args.folder)
        except Exception as e:  # report every failure, then go on
            good, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        watch.cancel()
        if time.time() - started > 8:
            print("SLOW ", name, f"{time.time() - started:.0f}s", flush=True)
        if not good or "0 rows" == note[:6]:
            print(("BAD  " if not good else "EMPTY"), name, note, flush=True)
        if not good:
            bad.append(name)
    print(f"{len(names) - len(bad)} of {len(names)} agree; with SQL: "
          f"{sum(n in registry.oracle_sql() for n in names)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
