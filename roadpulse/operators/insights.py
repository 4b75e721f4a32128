"""Decision tables: severity ranking (C7), hourly cluster profile (C8) and map
table (C9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.functions.columns import floor_at_zero, rounded


def with_severity(clusters: DataFrame, low_confidence_days: int = 100) -> DataFrame:
    """Expected slowdown per peak = max(slowdown, 0) x frequency; severity is
    the worse peak; primary peak AM unless AM < PM or AM is missing; confidence
    'Lower' under ``low_confidence_days`` active days (B9, B15, B16)."""
    am = floor_at_zero("am_relative_slowdown") * F.col("am_slowdown_frequency")
    pm = floor_at_zero("pm_relative_slowdown") * F.col("pm_slowdown_frequency")
    d = clusters.withColumn("am_expected_slowdown", am).withColumn("pm_expected_slowdown", pm)
    return d.withColumns({
        "candidate_severity": F.greatest("am_expected_slowdown", "pm_expected_slowdown"),
        "primary_peak": F.when(F.col("am_expected_slowdown") >= F.col("pm_expected_slowdown"), F.lit("AM"))
        .otherwise(F.lit("PM")),
        "confidence": F.when(F.col("active_days") < low_confidence_days, F.lit("Lower"))
        .otherwise(F.lit("Standard")),
    })


def candidate_severity(clusters: DataFrame, low_confidence_days: int = 100, n: int = 20,
                       digits: int | None = 2) -> DataFrame:
    """Top ``n`` segments by candidate severity (C7); ties by osm_id."""
    d = with_severity(clusters, low_confidence_days)
    top = d.orderBy(F.col("candidate_severity").desc_nulls_last(), "osm_id").limit(n)
    return top.select(
        "osm_id", "cluster_label", "primary_peak", rounded("candidate_severity", digits).alias("candidate_severity"),
        "confidence", *[rounded(c, digits).alias(c) for c in (
            "am_relative_slowdown", "am_slowdown_frequency", "pm_relative_slowdown", "pm_slowdown_frequency")],
        "observation_count", "active_days")


def cluster_hour_profile(daily: DataFrame, clusters: DataFrame, digits: int | None = 4) -> DataFrame:
    """Mean relative slowdown (segment baseline - segment-hour mean) per
    cluster label and hour, segments weighted equally (C8, G40, J7, J8).

    The label table has one row per clustered segment; AQE broadcasts it when
    its measured size allows, otherwise it is a shuffle join on ``osm_id``.
    The segment baseline is a window over the segment's <= 24 hourly rows."""
    from pyspark.sql import Window
    d = daily.join(clusters.select("osm_id", "cluster_label"), "osm_id")
    seg_hour = d.groupBy("osm_id", "cluster_label", "hour").agg(
        F.avg("daily_average_velocity").alias("hourly"), F.sum("daily_average_velocity").alias("_s"),
        F.count("daily_average_velocity").alias("_n"))
    w = Window.partitionBy("osm_id")
    seg_hour = seg_hour.withColumn("baseline", F.sum("_s").over(w) / F.sum("_n").over(w))
    return (seg_hour.groupBy("cluster_label", F.col("hour").cast("int").alias("hour"))
            .agg(rounded(F.avg(F.col("baseline") - F.col("hourly")), digits).alias("relative_slowdown"))
            .orderBy("cluster_label", "hour"))


def segment_centres(obs: DataFrame) -> DataFrame:
    """Mean longitude and latitude per segment."""
    return obs.groupBy("osm_id").agg(F.avg("longitude").alias("lon"), F.avg("latitude").alias("lat"))


def segment_map(obs: DataFrame, clusters: DataFrame, n: int = 20, low_confidence_days: int = 100,
                digits: int | None = 6) -> DataFrame:
    """Map table: every clustered segment with its centre, label, severity and
    a flag for the top ``n`` candidates (C9, J9).  The top-n id list is bounded
    by ``n`` and broadcast."""
    sev = with_severity(clusters, low_confidence_days)
    top = (sev.orderBy(F.col("candidate_severity").desc_nulls_last(), "osm_id").limit(n)
           .select("osm_id", F.lit(True).alias("is_top_candidate")))
    geo = sev.join(segment_centres(obs), "osm_id").join(F.broadcast(top), "osm_id", "left")
    return geo.select("osm_id", "cluster_id", "cluster_label", rounded("lon", digits).alias("lon"),
                      rounded("lat", digits).alias("lat"),
                      rounded("candidate_severity", digits).alias("candidate_severity"),
                      F.coalesce("is_top_candidate", F.lit(False)).alias("is_top_candidate"))
