"""Compare registered queries with their SQL on DuckDB.

usage: python tools/check.py SF_DIR [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Small inputs: keep a task per core instead of merging partitions below 1 MB.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .config("spark.sql.files.openCostInBytes", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def main() -> int:
    from foldsmith.queries import ORACLES, QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = session()
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = []
    for name in names or list(QUERIES):
        start = time.perf_counter()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            spent = time.perf_counter() - start
            if name not in ORACLES:
                print(f"rows  {name:28s} {len(got):8d} rows {spent:6.1f}s", flush=True)
                if not got:
                    failed.append(name)
                continue
            start = time.perf_counter()
            cursor = duck.execute(ORACLES[name])
            want_columns = [d[0] for d in cursor.description]
            want = cursor.fetchall()
            other = time.perf_counter() - start
            a, b = rows_of(df.columns, got), rows_of(want_columns, want)
            same = sorted(df.columns) == sorted(want_columns) and a == b
            print(
                f"{'ok   ' if same else 'DIFF '} {name:28s} {len(a):8d} rows {spent:6.1f}s sql {other:5.1f}s",
                flush=True,
            )
            if not same:
                failed.append(name)
                print("   columns", sorted(df.columns), sorted(want_columns), len(a), len(b))
                bad = [(x, y) for x, y in zip(a, b) if x != y]
                print("   differing", len(bad), bad[:2])
        except Exception as error:  # noqa: BLE001 - report every query
            failed.append(name)
            print(f"FAIL  {name}: {str(error)[:1500]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
