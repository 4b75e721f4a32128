"""Descriptive profiles of observations: table check, hourly and segment
profiles, low-velocity screen, partial/final aggregates and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.columns import rounded


def table_summary(obs: DataFrame) -> DataFrame:
    """Row count and time bounds (G1)."""
    return obs.agg(F.count(F.lit(1)).alias("total_row_count"),
                   F.min("timestamp").alias("min_timestamp"),
                   F.max("timestamp").alias("max_timestamp"))


def hourly_profile(obs: DataFrame, digits: int | None = 2) -> DataFrame:
    """Observations and mean velocity per hour of day, ordered by hour."""
    return (obs.groupBy(F.col("hour").cast("int").alias("hour"))
            .agg(F.count(F.lit(1)).alias("total_row_count"),
                 rounded(F.avg("velocity"), digits).alias("average_velocity"))
            .orderBy("hour"))


def _segment_velocity(obs: DataFrame) -> DataFrame:
    return obs.groupBy("osm_id").agg(
        F.count(F.lit(1)).alias("total_row_count"),
        F.avg("velocity").alias("_avg"),
        F.min("velocity").alias("_min"),
        F.max("velocity").alias("_max"),
    )


def _rounded_profile(df: DataFrame, digits: int | None) -> DataFrame:
    return df.select("osm_id", "total_row_count",
                     rounded("_avg", digits).alias("average_velocity"),
                     rounded("_min", digits).alias("minimum_velocity"),
                     rounded("_max", digits).alias("maximum_velocity"))


def segment_profile(obs: DataFrame, n: int = 20, digits: int | None = 2) -> DataFrame:
    """Most observed segments with mean/min/max velocity (G3, top-k)."""
    s = _segment_velocity(obs)
    return _rounded_profile(s.orderBy(F.col("total_row_count").desc(), "osm_id").limit(n), digits)


def low_velocity_screen(obs: DataFrame, min_obs: int = 5000, n: int = 20, digits: int | None = 2) -> DataFrame:
    """Well-observed segments with the lowest mean velocity (G4); ordered by the
    unrounded mean."""
    s = _segment_velocity(obs).where(F.col("total_row_count") >= min_obs)
    return _rounded_profile(s.orderBy(F.col("_avg").asc(), "osm_id").limit(n), digits)


def _velocity_aggs():
    v = F.col("velocity")
    return [F.count(v).alias("observation_count"), F.sum(v).alias("velocity_sum"),
            F.min(v).alias("velocity_min"), F.max(v).alias("velocity_max")]


def hourly_date_stats(obs: DataFrame) -> DataFrame:
    """Per (date, hour, day of week): count, sum, min, max and mean velocity.

    Partial (map-side) then final aggregation is Spark's own two-phase plan;
    the chunked merge of the analysed workload is not needed."""
    g = (obs.where(F.col("timestamp").isNotNull())
         .groupBy(F.to_date("timestamp").alias("date"), F.col("hour").cast("int").alias("hour"),
                  F.col("day_of_week").cast("int").alias("day_of_week"))
         .agg(*_velocity_aggs()))
    return g.withColumn("velocity_mean", F.try_divide("velocity_sum", "observation_count"))


def segment_stats(obs: DataFrame) -> DataFrame:
    """Per segment: count, sum, min, max and mean velocity."""
    g = obs.where(F.col("osm_id").isNotNull()).groupBy("osm_id").agg(*_velocity_aggs())
    return g.withColumn("velocity_mean", F.try_divide("velocity_sum", "observation_count"))


def hour_date_rollup(hourly: DataFrame) -> DataFrame:
    """Roll the (date, hour) table up to per-hour and per-date profiles in one
    pass with GROUPING SETS ((hour), (date)); mean = sum of sums / sum of counts
    (G30).  ``level`` says which grouping a row belongs to."""
    g = hourly.groupingSets([["hour"], ["date"]], "hour", "date").agg(
        F.sum("observation_count").cast("long").alias("observation_count"),
        F.sum("velocity_sum").alias("velocity_sum"),
        F.grouping_id().alias("_gid"))
    return g.select(F.when(F.col("_gid") == 1, F.lit("hour")).otherwise(F.lit("date")).alias("level"),
                    "hour", "date", "observation_count", "velocity_sum",
                    F.try_divide("velocity_sum", "observation_count").alias("velocity_mean"))


def rollup_by(hourly: DataFrame, key: str) -> DataFrame:
    """Roll the (date, hour) table up to one key (``'hour'`` or ``'date'``):
    observations, velocity sum and weighted mean sum/count (G30, one grouping)."""
    g = hourly.groupBy(key).agg(F.sum("observation_count").cast("long").alias("observation_count"),
                                F.sum("velocity_sum").alias("velocity_sum"))
    return g.withColumn("velocity_mean", F.try_divide("velocity_sum", "observation_count")).orderBy(key)


def top_segment_share(obs: DataFrame, n: int = 20) -> DataFrame:
    """Share of all observations held by the ``n`` most observed segments.

    The total is a scalar subquery over the same per-segment counts (no
    cross join); the top-k is ``TakeOrderedAndProject``."""
    counts = obs.groupBy("osm_id").agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c")).scalar()
    top = counts.orderBy(F.col("c").desc(), "osm_id").limit(n)
    return top.agg(F.sum("c").cast("long").alias("top_rows")).select(
        F.lit(n).alias("top_n"), "top_rows", total.cast("long").alias("total_rows"),
        F.try_divide(F.col("top_rows").cast("double"), total.cast("double")).alias("share"))
