"""The feasibility scan: one pass over the raw rows writes the clean table and
gathers every count of the report on the way (A4, C10).

The counts are observed metrics (``DataFrame.observe``) on the write itself.
They sit in the job's last stage, after the shuffle by date: Spark counts the
metrics of such a task once, also if a lost executor makes it run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from roadpulse.params import MAX_ABS_LATITUDE, MAX_ABS_LONGITUDE, NEAR_ZERO_VELOCITY, SLOW_VELOCITY
from roadpulse.sources.raw import clean

MISSING = "_missing"


def flagged(raw: DataFrame, on_bad: str = "null") -> DataFrame:
    """Clean observations with the raw columns' missing values as bits of ``_missing``."""
    bits = sum([F.when(F.col(f"`{c}`").isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(raw.columns)], F.lit(0))
    return clean(raw.withColumn(MISSING, bits), on_bad, keep=(MISSING,))


def metrics(columns: list[str], near: float = NEAR_ZERO_VELOCITY, slow: float = SLOW_VELOCITY) -> list[Column]:
    """Counts over flagged rows: validity, missing values, moments and near-zero velocities."""
    lon, lat, v = F.col("longitude"), F.col("latitude"), F.col("velocity")
    outside = (F.abs(lon) > MAX_ABS_LONGITUDE) | (F.abs(lat) > MAX_ABS_LATITUDE)
    out = [
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("timestamp").isNull()).alias("invalid_timestamp_rows"),
        F.count_if(lon.isNull() | lat.isNull() | outside).alias("invalid_coordinate_rows"),
        F.count_if(lon.isNull() | lat.isNull()).alias("unparsed_coordinate_rows"),
        F.count_if((lon == 0) | (lat == 0)).alias("zero_coordinate_rows"),
        F.count_if(outside).alias("out_of_range_coordinate_rows"),
        F.min("timestamp").alias("min_timestamp"), F.max("timestamp").alias("max_timestamp"),
        F.count(v).alias("velocity_count"), F.avg(v).alias("velocity_mean"), F.stddev_pop(v).alias("velocity_std"),
        F.min(v).alias("velocity_min"), F.max(v).alias("velocity_max"),
        F.count_if(v == 0).alias("zero_exact"), F.count_if(v < near).alias("near_zero"), F.count_if(v < slow).alias("below_slow"),
    ]
    return out + [F.count_if(F.col(MISSING).bitwiseAND(F.lit(1 << i)) != 0).alias(f"missing {c}") for i, c in enumerate(columns)]


def write_observed(raw: DataFrame, path: str, on_bad: str = "null") -> dict:
    """Write the clean table, partitioned by date, and return the counts of the rows that went through: with
    ``on_bad='drop'`` also those without a timestamp, which are counted and then left out.

    Rows are dealt by date; adaptive execution splits a date with many rows and joins small ones."""
    seen = Observation("feasibility")
    rows = flagged(raw, "null" if on_bad == "drop" else on_bad).hint("rebalance", "date").observe(seen, *metrics(raw.columns))
    if on_bad == "drop":
        rows = rows.where(F.col("timestamp").isNotNull())
    rows.drop(MISSING).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("date").parquet(path)
    return dict(seen.get)


def as_table(spark, counts: dict) -> DataFrame:
    """(metric, value) of the counts; timestamps as seconds since 1970."""
    def value(x):
        return None if x is None else (x - type(x)(1970, 1, 1)).total_seconds() if hasattr(x, "year") else float(x)
    return spark.createDataFrame([(k, value(v)) for k, v in counts.items()], "metric string, value double")


def one_row(spark, counts: dict, names: dict[str, str]) -> DataFrame:
    """One row of the ``names`` (column: type) among the counts."""
    return spark.createDataFrame([tuple(counts[n] for n in names)], ", ".join(f"{n} {t}" for n, t in names.items()))


def reports(spark, counts: dict, columns: list[str]) -> dict[str, DataFrame]:
    """The report's tables that the counts alone give."""
    total = counts["total_rows"]
    share = lambda n: round(100.0 * n / total, 2) if total else None
    missing = [(c, counts[f"missing {c}"], share(counts[f"missing {c}"])) for c in columns]
    near = [(total, counts["zero_exact"], share(counts["zero_exact"]), counts["near_zero"], share(counts["near_zero"]), counts["below_slow"],
             share(counts["below_slow"]), counts["velocity_min"])]
    return {
        "validity_report": one_row(spark, counts, dict.fromkeys(
            ("total_rows", "invalid_timestamp_rows", "invalid_coordinate_rows", "unparsed_coordinate_rows", "zero_coordinate_rows",
             "out_of_range_coordinate_rows"), "long") | {"min_timestamp": "timestamp_ntz", "max_timestamp": "timestamp_ntz"}),
        "null_audit": spark.createDataFrame(missing, "column_name string, missing_count long, pct_missing double"),
        "velocity_moments": one_row(spark, counts, {"velocity_count": "long", "velocity_mean": "double", "velocity_std": "double",
                                                    "velocity_min": "double", "velocity_max": "double"}),
        "near_zero_report": spark.createDataFrame(
            near, "total_rows long, zero_exact long, pct_zero_exact double, near_zero long, pct_near_zero double, below_slow long, "
                  "pct_below_slow double, min_velocity double"),
    }
