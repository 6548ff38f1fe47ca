"""Run registered queries next to their SQL at one scale: python -m tests.oracle_check [prefix ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cpus: str = "8") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("oracle-check")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canon(df: pd.DataFrame) -> list[str]:
    def text(v) -> str:
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "NULL"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, np.integer)):
            return str(int(v))
        if isinstance(v, (float, np.floating)):
            return str(int(v)) if float(v).is_integer() and abs(v) < 2**53 and repr(float(v))[0] != "-0" else repr(float(v))
        return str(v)

    df = df[sorted(df.columns)]
    return sorted("|".join(text(v) for v in row) for row in df.itertuples(index=False, name=None))


def compare(spark, con, name: str, fn, sql: str | None, sf: str) -> str:
    t = time.time()
    got = fn(spark, sf).toPandas()
    took = time.time() - t
    if sql is None:
        return f"ROWS {len(got)} ({took:.1f}s)"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canon(got), canon(want)
    if a == b:
        return f"ok {len(a)} ({took:.1f}s)" if a else f"EMPTY ({took:.1f}s)"
    diff = [(p, q) for p, q in zip(a, b) if p != q][:3]
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if got[c].dtype != want[c].dtype}
    return (f"FAIL rows {len(a)} vs {len(b)}, {sum(p != q for p, q in zip(a, b))} differ, kinds {kinds}\n"
            f"   columns {sorted(got.columns)}\n   " + "\n   ".join(f"{p}\n   {q}" for p, q in diff))


def main() -> int:
    import __spark_entry__ as entry
    sf = os.environ.get("CHECK_SF", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, con, bad = session(), duck(sf), 0
    checks = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            line = compare(spark, con, name, fn, checks.get(name), sf)
        except Exception as exc:  # report and go on with the next query
            line = f"ERROR {type(exc).__name__}: {str(exc)[:1500]}"
        bad += not (line.startswith("ok") or line.startswith("ROWS"))
        print(f"{name}: {line}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
