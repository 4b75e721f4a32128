"""Per-segment feature table (C5) and the threshold-selection report (C11).

Plan: three per-segment aggregates, all keyed by ``osm_id`` and joined left
onto the coverage table --
* coverage: two-level aggregation (segment, date) -> segment, so distinct
  active days need no ``COUNT(DISTINCT)`` expansion and a hot segment is
  combined map-side;
* moving-velocity median (exact, skew-safe ``exact_quantiles``) and sample sd;
* peak features from the daily summary in one window+aggregate over
  ``osm_id`` (the daily table holds at most calendar days x 24 rows per
  segment, so the window partition is bounded).  The analysed workload ran
  six queries and a seven-way merge for these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.columns import indicator, rounded
from roadpulse.operators.quantile import exact_quantiles
from roadpulse.params import (
    AM_HOURS,
    NEAR_ZERO_VELOCITY,
    PM_HOURS,
    THRESHOLD_GRID_ACTIVE_DAYS,
    THRESHOLD_GRID_OBSERVATIONS,
)

FEATURE_COLUMNS = (
    "osm_id", "median_velocity", "velocity_std", "observation_count", "active_days", "am_velocity",
    "pm_velocity", "am_relative_slowdown", "pm_relative_slowdown", "am_slowdown_frequency",
    "pm_slowdown_frequency", "zero_velocity_observation_count",
)


def segment_coverage(obs: DataFrame, near: float = NEAR_ZERO_VELOCITY) -> DataFrame:
    """observation_count, active_days (distinct dates) and near-zero count per
    segment (G13, G14).  Rows without a timestamp count as observations but
    not as an active day, as COUNT(DISTINCT DATE(ts)) does."""
    per_day = obs.groupBy("osm_id", F.to_date("timestamp").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("velocity") < near).alias("z"))
    return per_day.groupBy("osm_id").agg(
        F.sum("n").cast("long").alias("observation_count"),
        F.count("d").alias("active_days"),
        F.sum("z").cast("long").alias("zero_velocity_observation_count"))


def moving_velocity_stats(obs: DataFrame, moving: float = NEAR_ZERO_VELOCITY, digits: int | None = 4,
                          approx_accuracy: int | None = None) -> DataFrame:
    """Median and sample sd of velocity >= ``moving`` per segment.

    Exact by default (``exact_quantiles``).  ``approx_accuracy`` switches the
    median to ``percentile_approx`` (mergeable sketches, one aggregation with
    the sd, relative rank error 1/accuracy) for runs where an approximate
    median is acceptable."""
    mv = obs.where(F.col("velocity") >= moving).select("osm_id", "velocity")
    if approx_accuracy:
        both = mv.groupBy("osm_id").agg(
            F.percentile_approx("velocity", 0.5, approx_accuracy).alias("median_velocity"),
            F.stddev_samp("velocity").alias("velocity_std"))
        return both.select("osm_id", rounded("median_velocity", digits).alias("median_velocity"),
                           rounded("velocity_std", digits).alias("velocity_std"))
    sd = mv.groupBy("osm_id").agg(F.stddev_samp("velocity").alias("velocity_std"))
    med = exact_quantiles(mv, ["osm_id"], "velocity", [0.5], names=["median_velocity"])
    return med.join(sd, "osm_id").select("osm_id", rounded("median_velocity", digits).alias("median_velocity"),
                                         rounded("velocity_std", digits).alias("velocity_std"))


def peak_features(daily: DataFrame, am: tuple[int, ...] = AM_HOURS, pm: tuple[int, ...] = PM_HOURS) -> DataFrame:
    """AM/PM peak means, non-peak baselines and slowdown frequencies.

    A frequency is NULL when the segment has no peak rows or no non-peak
    baseline (the inner join of the analysed SQL drops such segments)."""
    v, hr = F.col("daily_average_velocity"), F.col("hour")
    is_am, is_pm = hr.isin(*am), hr.isin(*pm)
    w = Window.partitionBy("osm_id")
    d = daily.select("osm_id", hr.alias("hour"), v.alias("daily_average_velocity"),
                     F.avg(F.when(~is_am, v)).over(w).alias("non_am_baseline_velocity"),
                     F.avg(F.when(~is_pm, v)).over(w).alias("non_pm_baseline_velocity"))
    g = d.groupBy("osm_id").agg(
        F.avg(F.when(is_am, v)).alias("am_velocity"),
        F.avg(F.when(is_pm, v)).alias("pm_velocity"),
        F.max("non_am_baseline_velocity").alias("non_am_baseline_velocity"),
        F.max("non_pm_baseline_velocity").alias("non_pm_baseline_velocity"),
        F.avg(F.when(is_am, indicator(v < F.col("non_am_baseline_velocity")))).alias("_amf"),
        F.avg(F.when(is_pm, indicator(v < F.col("non_pm_baseline_velocity")))).alias("_pmf"),
    )
    return g.select(
        "osm_id", "am_velocity", "pm_velocity", "non_am_baseline_velocity", "non_pm_baseline_velocity",
        F.when(F.col("non_am_baseline_velocity").isNotNull(), F.col("_amf")).alias("am_slowdown_frequency"),
        F.when(F.col("non_pm_baseline_velocity").isNotNull(), F.col("_pmf")).alias("pm_slowdown_frequency"),
    )


def segment_features(obs: DataFrame, daily: DataFrame, am: tuple[int, ...] = AM_HOURS,
                     pm: tuple[int, ...] = PM_HOURS, moving: float = NEAR_ZERO_VELOCITY,
                     min_obs: int = 100, min_active_days: int = 10, digits: int | None = 4,
                     approx_accuracy: int | None = None) -> DataFrame:
    """One row per qualified segment with the twelve feature columns.

    Missing peak data stays NULL (never imputed as zero).  ``approx_accuracy``
    is passed to ``moving_velocity_stats``."""
    cov = segment_coverage(obs, near=moving).where(
        (F.col("observation_count") >= min_obs) & (F.col("active_days") >= min_active_days))
    vel = moving_velocity_stats(obs, moving=moving, digits=digits, approx_accuracy=approx_accuracy)
    peaks = peak_features(daily, am, pm)
    f = cov.join(vel, "osm_id", "left").join(peaks, "osm_id", "left")
    return f.select(
        "osm_id", "median_velocity", "velocity_std", "observation_count", "active_days",
        rounded("am_velocity", digits).alias("am_velocity"),
        rounded("pm_velocity", digits).alias("pm_velocity"),
        rounded(F.col("non_am_baseline_velocity") - F.col("am_velocity"), digits).alias("am_relative_slowdown"),
        rounded(F.col("non_pm_baseline_velocity") - F.col("pm_velocity"), digits).alias("pm_relative_slowdown"),
        rounded("am_slowdown_frequency", digits).alias("am_slowdown_frequency"),
        rounded("pm_slowdown_frequency", digits).alias("pm_slowdown_frequency"),
        "zero_velocity_observation_count",
    )


def complete_cohort(features: DataFrame) -> DataFrame:
    """Segments with every feature present."""
    return features.na.drop("any")


def excluded_cohort(features: DataFrame) -> DataFrame:
    """Segments with at least one missing feature (F7 complement)."""
    anynull = None
    for c in features.columns:
        cond = F.col(c).isNull()
        anynull = cond if anynull is None else (anynull | cond)
    return features.where(anynull)


def cohort_comparison(features: DataFrame, digits: int | None = 1) -> DataFrame:
    """Mean and exact median of observations and active days, complete vs
    excluded segments (G35)."""
    allpresent = None
    for c in features.columns:
        cond = F.col(c).isNotNull()
        allpresent = cond if allpresent is None else (allpresent & cond)
    t = features.select(F.when(allpresent, F.lit("complete")).otherwise(F.lit("excluded")).alias("cohort"),
                        F.col("observation_count").cast("double").alias("observation_count"),
                        F.col("active_days").cast("double").alias("active_days"))
    m = t.groupBy("cohort").agg(F.count(F.lit(1)).alias("segments"),
                                F.avg("observation_count").alias("mean_observations"),
                                F.avg("active_days").alias("mean_active_days"))
    from roadpulse.operators.cluster import grouped_medians
    meds = grouped_medians(t, ["cohort"], {"observation_count": "median_observations",
                                           "active_days": "median_active_days"})
    j = m.join(meds, "cohort")
    return j.select("cohort", "segments", *[rounded(c, digits).alias(c) for c in (
        "mean_observations", "median_observations", "mean_active_days", "median_active_days")])


def threshold_grid(coverage: DataFrame, obs_thresholds=THRESHOLD_GRID_OBSERVATIONS,
                   day_thresholds=THRESHOLD_GRID_ACTIVE_DAYS, digits: int | None = 1) -> DataFrame:
    """Surviving segments for every (min observations, min active days) pair
    (G34), for grids of any size: one histogram of segments over the cells of
    the grid, then suffix sums over days and over observations.  A segment is
    counted once; the grid is never joined with the segments."""
    def step(column: str, thresholds) -> Column:
        """How many of the thresholds a segment reaches."""
        return F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t <= F.col(column)))

    obs_thresholds, day_thresholds = sorted(set(obs_thresholds)), sorted(set(day_thresholds))
    cells = coverage.groupBy(step("observation_count", obs_thresholds).alias("i"), step("active_days", day_thresholds).alias("j")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = coverage.sparkSession.range(len(obs_thresholds) + 1).select(F.col("id").cast("int").alias("i")).select(
        "i", F.explode(F.sequence(F.lit(0), F.lit(len(day_thresholds)))).alias("j"), F.lit(0).cast("long").alias("n"))
    dense = grid.unionByName(cells).groupBy("i", "j").agg(F.sum("n").alias("n"))
    over_days = dense.withColumn("n", F.sum("n").over(Window.partitionBy("i").orderBy(F.col("j").desc())))
    over_both = over_days.withColumn("n", F.sum("n").over(Window.partitionBy("j").orderBy(F.col("i").desc())))
    at = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(k))
    total = over_both.where((F.col("i") == 0) & (F.col("j") == 0)).select("n").scalar()
    return over_both.where((F.col("i") > 0) & (F.col("j") > 0)).select(
        at(obs_thresholds, "i").alias("min_observations"), at(day_thresholds, "j").alias("min_active_days"), F.col("n").alias("surviving_segments"),
        rounded(F.try_divide(F.col("n") * 100.0, total), digits).alias("pct_of_total"))


def coverage_histogram(coverage: DataFrame, columns=("observation_count", "active_days"), bins: int = 100) -> DataFrame:
    """Equal-width histogram (``bins`` bins over [min, max], last bin closed)
    of each coverage column (G41); every bin is listed, empty ones with 0."""
    out = None
    for c in columns:
        x = F.col(c).cast("double")
        mm = coverage.agg(F.min(x).alias("mn"), F.max(x).alias("mx"))
        lo = F.when(F.col("mx") > F.col("mn"), F.col("mn")).otherwise(F.col("mn") - 0.5)
        hi = F.when(F.col("mx") > F.col("mn"), F.col("mx")).otherwise(F.col("mx") + 0.5)
        edges = mm.select(lo.alias("lo"), hi.alias("hi"))
        lo_s, hi_s = edges.select("lo").scalar(), edges.select("hi").scalar()
        b = F.least(F.floor((x - lo_s) * bins / (hi_s - lo_s)), F.lit(bins - 1)).cast("int")
        counts = coverage.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("segments"))
        grid = edges.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
        h = grid.join(counts, "bin", "left").select(
            F.lit(c).alias("measure"), "bin",
            (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"),
            (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_end"),
            F.coalesce("segments", F.lit(0)).cast("long").alias("segments"))
        out = h if out is None else out.unionByName(h)
    return out
