"""Run registered queries against their SQL in DuckDB: ``check.py [sf] [name-part ...]``."""

from __future__ import annotations

import decimal
import importlib
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, decimal.Decimal)) and v == int(v):
        return repr(int(v))
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        if math.isnan(v):
            return "nan"
        return f"{v + 0.0:.6f}" if v != 0 else "0.000000"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def session():
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    root = f"/root/testdata/sf{sf}"
    entry = importlib.import_module("__spark_entry__")
    queries, oracle = entry.queries(), entry.oracle_sql()
    spark = session()
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        started = time.time()
        try:
            df = fn(spark, root)
            got = [tuple(r) for r in df.collect()]
        except Exception as exc:  # report and go on
            bad += 1
            print(f"ERROR {name}: {str(exc)[:1500]}")
            continue
        took = time.time() - started
        if name not in oracle:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s")
            bad += not got
            continue
        started = time.time()
        try:
            rel = con.execute(oracle[name])
            columns = [d[0] for d in rel.description]
            types = {d[0]: str(d[1]) for d in rel.description}
            want = rel.fetchall()
        except Exception as exc:
            bad += 1
            print(f"SQLERR {name}: {str(exc)[:1200]}")
            continue
        sql_took = time.time() - started
        a, b = rows_of(df.columns, got), rows_of(columns, want)
        same_cols = sorted(df.columns) == sorted(columns)
        odd = {c: x for c, x in types.items() if "HUGEINT" in x or "DECIMAL" in x}
        ok = same_cols and a == b and got
        bad += not ok
        print(
            f"{'ok   ' if ok else 'DIFF '} {name}: {len(a)}/{len(b)} rows "
            f"{took:.1f}s sql {sql_took:.1f}s {odd or ''}"
        )
        if not ok:
            print("   cols", sorted(df.columns), sorted(columns))
            only_a = sorted(set(a) - set(b))[:3]
            only_b = sorted(set(b) - set(a))[:3]
            print("   spark", only_a, "\n   sql  ", only_b)
    print("failures:", bad)


if __name__ == "__main__":
    main()
