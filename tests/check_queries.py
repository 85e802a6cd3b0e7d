"""Compare every catalog query with its SQL. Usage: check_queries.py [sf_dir] [names...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "NULL"
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            v = float(v) + 0.0  # pandas may give nullable integers as floats
            return str(int(v)) if v.is_integer() else repr(v)
        return str(v)
    return sorted(tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False, name=None))


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(sf), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            got = fn(spark, sf).toPandas()
            took = time.time() - t
            t = time.time()
            if name not in sql:
                print(f"{name:32s} rows={len(got):7d} {took:6.2f}s (no SQL)", flush=True)
                continue
            want = con.execute(sql[name]).df()
            d = difference(got, want)
            print(f"{name:32s} rows={len(got):7d} {took:6.2f}s sql {time.time() - t:6.2f}s {'OK' if d is None else 'DIFF ' + d}", flush=True)
        except Exception as e:  # keep going; the list of failures is the result
            d = str(e)[:600]
            print(f"{name:32s} ERROR {d}", flush=True)
        if d:
            failed.append(name)
    print("failed:", failed)
