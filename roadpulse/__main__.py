"""Command line: run every stage on a raw observation file.

    python -m roadpulse run RAW_PATH OUT_DIR [--min-daily-obs 5] [--k 5] ...

Uses the active Spark configuration (spark-submit / defaults); thresholds
default to the analysed workload's values.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from roadpulse.params import ClusterParams, Thresholds
from roadpulse.plans.stages import run_all


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="roadpulse")
    sub = ap.add_subparsers(dest="cmd", required=True)
    run = sub.add_parser("run", help="raw file -> every result table")
    run.add_argument("raw_path")
    run.add_argument("out_dir")
    t0, c0 = Thresholds(), ClusterParams()
    for name in t0.__dataclass_fields__:
        run.add_argument(f"--{name.replace('_', '-')}", type=type(getattr(t0, name)), default=getattr(t0, name))
    run.add_argument("--k", type=int, default=c0.k)
    run.add_argument("--restarts", type=int, default=c0.restarts)
    run.add_argument("--seed", type=int, default=c0.seed)
    run.add_argument("--csv", action="store_true", help="also write feature and cluster tables as CSV")
    run.add_argument("--bucket-daily", type=int, default=None,
                     help="save the daily summary as a catalog table with this many osm_id buckets")
    run.add_argument("--on-bad", choices=("fail", "null", "drop"), default="fail",
                     help="rows without a usable timestamp: raise, keep with NULL time parts, or drop")
    a = ap.parse_args(argv)
    t = Thresholds(**{n: getattr(a, n) for n in t0.__dataclass_fields__})
    cp = ClusterParams(k=a.k, restarts=a.restarts, seed=a.seed)
    spark = SparkSession.builder.appName("roadpulse").getOrCreate()
    written = run_all(spark, a.raw_path, a.out_dir, t=t, cp=cp, on_bad=a.on_bad, fmt="csv" if a.csv else "parquet",
                      bucket_daily=a.bucket_daily)
    print(json.dumps(written, indent=2))


if __name__ == "__main__":
    main()
