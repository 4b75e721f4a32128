"""Daily segment-hour summary (the reusable sub-aggregate) and its check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_segment_hour(obs: DataFrame, min_daily_obs: int = 5) -> DataFrame:
    """One row per (segment, date, hour) with at least ``min_daily_obs`` rows.

    Partial aggregation runs map-side, so a hot segment is collapsed to one
    row per (date, hour) per input partition before the shuffle; the output is
    bounded by segments x calendar days x 24 whatever the raw volume.
    """
    return (
        obs.groupBy("osm_id", F.to_date("timestamp").alias("observation_date"), "hour")
        .agg(F.count(F.lit(1)).alias("daily_observation_count"),
             F.avg("velocity").alias("daily_average_velocity"))
        .where(F.col("daily_observation_count") >= min_daily_obs)
        .select("osm_id", "observation_date", F.col("hour").cast("int").alias("hour"),
                "daily_observation_count", "daily_average_velocity")
    )


def daily_summary_check(daily: DataFrame) -> DataFrame:
    """Rows, distinct segments, first and last date of the summary."""
    return daily.agg(
        F.count(F.lit(1)).alias("summary_rows"),
        F.count_distinct("osm_id").alias("segments"),
        F.min("observation_date").alias("first_date"),
        F.max("observation_date").alias("last_date"),
    )
