"""Runs registered queries and their checking SQL side by side; usable as a script.

``python tests/compare.py [sf_dir] [name prefix ...]``
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value)


def normal(rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    """(spark rows, oracle rows, what differs or None)."""
    df = query(spark, sf_dir)
    rows = df.collect()
    rel = con.sql(sql)
    expected = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return len(rows), len(expected), f"columns {sorted(df.columns)} / {sorted(rel.columns)}"
    a, b = normal(rows, df.columns), normal(expected, rel.columns)
    if a == b:
        return len(rows), len(expected), None
    return (
        len(rows),
        len(expected),
        f"{sum((a - b).values())} only in spark, e.g. {next(iter(sorted((a - b), key=str)), None)}; "
        f"{sum((b - a).values())} only in sql, e.g. {next(iter(sorted((b - a), key=str)), None)} ({sorted(df.columns)})",
    )


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            if name not in oracle:
                print(f"rows {name} {query(spark, sf_dir).count()} {time.time() - start:.1f}s (no SQL)", flush=True)
                continue
            n, m, diff = compare(spark, con, sf_dir, name, query, oracle[name])
        except Exception as error:  # reported, then the run goes on with the next query
            n, m, diff = -1, -1, f"{type(error).__name__}: {str(error)[:1500]}"
            con = duck(sf_dir)
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {name} {n}/{m} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
