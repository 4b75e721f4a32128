"""Run every registered query on Spark and its oracle on DuckDB; compare.

Usage: python tests/compare.py [sf_dir] [name ...]
Prints one line per query: OK / MISMATCH / NO-ORACLE (rows only).
"""
from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canon(v):
    import pandas as pd
    if v is None or (not isinstance(v, (list, tuple, dict)) and pd.isna(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "item"):
        return canon(v.item())
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False):
        out.append(tuple(canon(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    import __spark_entry__ as E
    from roadpulse.session import local_session
    spark = local_session()
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            spdf = sdf.toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"ERROR  {name}: spark failed: {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in orc:
            print(f"NO-ORACLE {name}: rows={len(spdf)} cols={list(spdf.columns)} t={ts:.1f}s")
            continue
        try:
            dpdf = con.sql(orc[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"ERROR  {name}: duckdb failed: {str(e)[:400]}")
            bad += 1
            continue
        sc, sr = rows_of(spdf)
        dc, dr = rows_of(dpdf)
        if sc != dc:
            print(f"MISMATCH {name}: columns spark={sc} duck={dc}")
            bad += 1
            continue
        if sr != dr:
            diff_s = [r for r in sr if r not in set(dr)][:3]
            diff_d = [r for r in dr if r not in set(sr)][:3]
            print(f"MISMATCH {name}: rows spark={len(sr)} duck={len(dr)}\n   spark-only {diff_s}\n   duck-only  {diff_d}")
            bad += 1
            continue
        print(f"OK     {name}: rows={len(sr)} t={ts:.1f}s")
    print(f"done, {bad} problems")
    spark.stop()


if __name__ == "__main__":
    main()
