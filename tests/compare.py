"""Queries beside their SQL: python -m tests.compare SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path


def canonical(rows, names):
    """Rows sorted, columns by name, floats to nine digits."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, float):
            return "null" if math.isnan(x) else f"{x:.9g}"
        return "null" if x is None else f"{float(x):.9g}" if isinstance(x, int) else str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compared(spark, name, sf_dir, query, sql):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    con.execute("set timezone = 'UTC'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    right = canonical(cursor.fetchall(), names)
    df = query(spark, sf_dir)
    left = canonical(df.collect(), df.columns)
    return sorted(names) == sorted(df.columns) and left == right, left, right


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or sql:
        began = time.time()
        try:
            same, left, right = compared(spark, name, sys.argv[1], queries[name], sql[name])
            print(name, "EQ" if same else "DIFFERS", len(left), len(right), f"{time.time() - began:.1f} s", flush=True)
            if not same:
                a, b = set(left), set(right)
                print("   only Spark", sorted(a - b)[:2], "only SQL", sorted(b - a)[:2], flush=True)
        except Exception as x:
            print(name, "FAILED", str(x)[:600], flush=True)


if __name__ == "__main__":
    main()
