"""Slowdown rankings: relative (C1), recurring daily (C2), weekday/weekend
and candidate bottlenecks (C4).

Plan shape shared by all four: one aggregation at segment-hour grain, then the
segment baseline as a window over ``osm_id`` on that aggregate (at most 24 rows
per segment, so the window partition is bounded whatever the raw volume), then
a top-k (``TakeOrderedAndProject``).  The analysed SQL instead aggregated the
same input twice and joined; the result is identical.

Ties at the LIMIT are broken by (osm_id, hour) so the result is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.columns import day_type, pct_drop, rounded, sd_from_variance


def _by_segment():
    return Window.partitionBy("osm_id")


def observation_baseline(obs: DataFrame) -> DataFrame:
    """Observation-weighted segment baseline: AVG(velocity) over all raw rows."""
    return obs.groupBy("osm_id").agg(F.avg("velocity").alias("baseline_velocity"))


def relative_slowdowns(obs: DataFrame, min_obs: int = 100, n: int = 50, digits: int | None = 2) -> DataFrame:
    """Segment-hour mean vs the segment's observation-weighted mean.

    Ordered by the unrounded difference (ascending), output rounded."""
    sh = obs.groupBy("osm_id", "hour").agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.sum("velocity").alias("_sum"),
        F.count("velocity").alias("_n"),
    )
    sh = sh.select(
        "osm_id", "hour", "observation_count",
        (F.col("_sum") / F.col("_n")).alias("hourly_velocity"),
        (F.sum("_sum").over(_by_segment()) / F.sum("_n").over(_by_segment())).alias("baseline_velocity"),
    ).where(F.col("observation_count") >= min_obs)
    diff = F.col("hourly_velocity") - F.col("baseline_velocity")
    return (
        sh.orderBy(diff.asc(), "osm_id", "hour").limit(n)
        .select("osm_id", F.col("hour").cast("int").alias("hour"), "observation_count",
                rounded("hourly_velocity", digits).alias("hourly_velocity"),
                rounded("baseline_velocity", digits).alias("baseline_velocity"),
                rounded(diff, digits).alias("velocity_difference"))
    )


def segment_hour_profile(obs: DataFrame, min_obs: int = 100) -> DataFrame:
    """Segment-hour observation count and mean velocity with a support
    threshold (G6)."""
    return (obs.groupBy("osm_id", F.col("hour").cast("int").alias("hour"))
            .agg(F.count(F.lit(1)).alias("observation_count"), F.avg("velocity").alias("hourly_velocity"))
            .where(F.col("observation_count") >= min_obs))


def recurring_summary(daily: DataFrame, min_days: int = 5) -> DataFrame:
    """Across-day summary per segment-hour: days, observations, mean, min, max
    and population variance of the daily means (G8, G9)."""
    return (_segment_hour_days(daily).where(F.col("observed_days") >= min_days)
            .select("osm_id", F.col("hour").cast("int").alias("hour"), "observed_days", "total_observations",
                    "average_daily_velocity", "minimum_daily_velocity", "maximum_daily_velocity",
                    "daily_velocity_variance"))


def _segment_hour_days(daily: DataFrame) -> DataFrame:
    """Across-day summary per segment-hour, unfiltered, with what the date-weighted
    segment baseline needs (sum and count of daily means)."""
    return daily.groupBy("osm_id", "hour").agg(
        F.count(F.lit(1)).alias("observed_days"),
        F.sum("daily_observation_count").cast("long").alias("total_observations"),
        F.avg("daily_average_velocity").alias("average_daily_velocity"),
        F.min("daily_average_velocity").alias("minimum_daily_velocity"),
        F.max("daily_average_velocity").alias("maximum_daily_velocity"),
        F.var_pop("daily_average_velocity").alias("daily_velocity_variance"),
        F.sum("daily_average_velocity").alias("_sum_daily"),
        F.count("daily_average_velocity").alias("_days_with_mean"),
    )


def recurring_slowdowns(daily: DataFrame, obs: DataFrame | None = None, baseline: DataFrame | None = None,
                        min_days: int = 5, n: int = 50, digits: int | None = 2) -> DataFrame:
    """Across-day segment-hour average vs the observation-weighted baseline.

    Ordered by the rounded difference as reported, output with the daily
    standard deviation (population, across days)."""
    if baseline is None:
        if obs is None:
            raise ValueError("recurring_slowdowns needs obs or a precomputed baseline")
        baseline = observation_baseline(obs)
    rs = _segment_hour_days(daily).where(F.col("observed_days") >= min_days)
    out = rs.join(baseline, "osm_id").select(
        "osm_id", F.col("hour").cast("int").alias("hour"), "observed_days", "total_observations",
        rounded("average_daily_velocity", digits).alias("average_daily_velocity"),
        rounded("baseline_velocity", digits).alias("baseline_velocity"),
        rounded(F.col("average_daily_velocity") - F.col("baseline_velocity"), digits).alias("velocity_difference"),
        rounded("maximum_daily_velocity", digits).alias("maximum_daily_velocity"),
        sd_from_variance("daily_velocity_variance", digits).alias("daily_velocity_std"),
    )
    return out.orderBy(F.col("velocity_difference").asc(), "osm_id", "hour").limit(n)


def weekday_weekend(daily: DataFrame, min_days: int = 10, n: int = 30, digits: int | None = 2) -> DataFrame:
    """Weekday vs weekend across-day means per segment-hour.

    One conditional aggregation (a pivot on day type) replaces the self-join
    of the analysed SQL; both sides need ``min_days`` dates.  Ordered by the
    unrounded difference."""
    dt = day_type("observation_date")
    wk, we = dt == "weekday", dt == "weekend"
    v = F.col("daily_average_velocity")
    p = daily.groupBy("osm_id", "hour").agg(
        F.count_if(wk).alias("weekday_days"),
        F.count_if(we).alias("weekend_days"),
        F.avg(F.when(wk, v)).alias("weekday_velocity"),
        F.avg(F.when(we, v)).alias("weekend_velocity"),
    ).where((F.col("weekday_days") >= min_days) & (F.col("weekend_days") >= min_days))
    diff = F.col("weekday_velocity") - F.col("weekend_velocity")
    return (
        p.orderBy(diff.asc(), "osm_id", "hour").limit(n)
        .select("osm_id", F.col("hour").cast("int").alias("hour"), "weekday_days", "weekend_days",
                rounded("weekday_velocity", digits).alias("weekday_velocity"),
                rounded("weekend_velocity", digits).alias("weekend_velocity"),
                rounded(diff, digits).alias("weekday_minus_weekend"))
    )


def weekday_weekend_selfjoin(daily: DataFrame, min_days: int = 10, n: int = 30, digits: int | None = 2) -> DataFrame:
    """The join form of C3 (day-type profile joined to itself); kept to test the
    pivot form against it."""
    prof = day_type_profile(daily, min_days)
    wkd = prof.where(F.col("day_type") == "weekday").select(
        "osm_id", "hour", F.col("observed_days").alias("weekday_days"),
        F.col("average_daily_velocity").alias("weekday_velocity"))
    wke = prof.where(F.col("day_type") == "weekend").select(
        "osm_id", "hour", F.col("observed_days").alias("weekend_days"),
        F.col("average_daily_velocity").alias("weekend_velocity"))
    j = wkd.join(wke, ["osm_id", "hour"])
    diff = F.col("weekday_velocity") - F.col("weekend_velocity")
    return (
        j.orderBy(diff.asc(), "osm_id", "hour").limit(n)
        .select("osm_id", F.col("hour").cast("int").alias("hour"), "weekday_days", "weekend_days",
                rounded("weekday_velocity", digits).alias("weekday_velocity"),
                rounded("weekend_velocity", digits).alias("weekend_velocity"),
                rounded(diff, digits).alias("weekday_minus_weekend"))
    )


def day_type_profile(daily: DataFrame, min_days: int = 10) -> DataFrame:
    """Segment x hour x day type: observed days and across-day mean (>= min_days)."""
    return (
        daily.groupBy("osm_id", "hour", day_type("observation_date").alias("day_type"))
        .agg(F.count(F.lit(1)).alias("observed_days"),
             F.avg("daily_average_velocity").alias("average_daily_velocity"))
        .where(F.col("observed_days") >= min_days)
    )


def date_weighted_baseline(daily: DataFrame) -> DataFrame:
    """Mean of daily means per segment (each date-hour weighs the same)."""
    return daily.groupBy("osm_id").agg(F.avg("daily_average_velocity").alias("baseline_velocity"))


def candidate_bottlenecks(daily: DataFrame, min_days: int = 30, min_obs: int = 200, n: int = 30,
                          digits: int | None = 2) -> DataFrame:
    """Recurring segment-hours slower than the segment's date-weighted baseline (C4).

    The baseline covers every daily row of the segment (before the support
    filter), exactly as a separate GROUP BY osm_id would; here it is a window
    over the <=24 segment-hour rows of the segment.  Ranked by the rounded
    slowdown percentage, then observed days."""
    shp = _segment_hour_days(daily).select(
        "*", (F.sum("_sum_daily").over(_by_segment()) / F.sum("_days_with_mean").over(_by_segment()))
        .alias("baseline_velocity"))
    shp = shp.where(
        (F.col("observed_days") >= min_days) & (F.col("total_observations") >= min_obs)
        & (F.col("average_daily_velocity") < F.col("baseline_velocity")) & (F.col("baseline_velocity") > 0)
    )
    b, a = F.col("baseline_velocity"), F.col("average_daily_velocity")
    out = shp.select(
        "osm_id", F.col("hour").cast("int").alias("hour"), "observed_days", "total_observations",
        rounded(a, digits).alias("average_daily_velocity"),
        rounded(b, digits).alias("baseline_velocity"),
        rounded(b - a, digits).alias("velocity_drop"),
        rounded(pct_drop(b, a), digits).alias("slowdown_percentage"),
        sd_from_variance("daily_velocity_variance", digits).alias("daily_velocity_std"),
    )
    return out.orderBy(F.col("slowdown_percentage").desc(), F.col("observed_days").desc(), "osm_id", "hour").limit(n)
