"""Run registered queries on Spark and their SQL on DuckDB and compare whole results.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from catchmark.catalog import all_queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, sf_dir, name, query):
    """(number of Spark rows, Spark seconds, problem text or None)."""
    t0 = time.time()
    df = query.run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t0
    if query.sql is None:
        return len(got), spent, None if got else "no rows"
    cur = con.execute(query.sql)
    cols = [c[0] for c in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return len(got), spent, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b]
        types = [type(v).__name__ for v in (want[0] if want else ())]
        return len(got), spent, f"{len(got)} vs {len(want)} rows, {len(bad)} differ, first {bad[:2]} types {types}"
    return len(got), spent, None if got else "no rows"


def session():
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries = all_queries()
    names = sys.argv[2:] or list(queries)
    failed = 0
    for name in names:
        t0 = time.time()
        try:
            n, spent, problem = compare(spark, con, sf_dir, name, queries[name])
        except Exception as e:  # report and go on with the next query
            n, spent, problem = -1, 0.0, f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        note = "" if queries[name].sql else " (rows only)"
        print(f"{'FAIL' if problem else 'ok  '} {name:22s} {n:8d} rows {spent:6.2f}s of {time.time() - t0:6.2f}s{note} {problem or ''}", flush=True)
    print("failed:", failed, "of", len(names))
