"""Feasibility checks on raw or clean observations: validity, missing values,
moments, distinct counts, duplicates, calendar coverage and gaps, near-zero
velocities.  Each check is one distributed aggregation (the chunk loop and its
merge bookkeeping of the analysed workload become partial/final aggregation).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadpulse.functions.columns import rounded
from roadpulse.operators.ordered import running
from roadpulse.operators.quantile import exact_quantiles
from roadpulse.params import MAX_ABS_LATITUDE, MAX_ABS_LONGITUDE, NEAR_ZERO_VELOCITY, SLOW_VELOCITY
from roadpulse.session import materialize
from roadpulse.sources.raw import parsed


def invalid_coordinate(lon, lat):
    return (lon.isNull() | lat.isNull() | (F.abs(lon) > MAX_ABS_LONGITUDE) | (F.abs(lat) > MAX_ABS_LATITUDE))


def validity_report(raw: DataFrame) -> DataFrame:
    """Total rows, unparsable timestamps, invalid coordinates and the valid
    timestamp range, in one pass (G21, F8)."""
    p = parsed(raw)
    return p.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("_ts").isNull()).alias("invalid_timestamp_rows"),
        F.count_if(invalid_coordinate(F.col("_lon"), F.col("_lat"))).alias("invalid_coordinate_rows"),
        F.count_if((F.col("_lon") == 0) | (F.col("_lat") == 0)).alias("zero_coordinate_rows"),
        F.count_if((F.abs("_lon") > MAX_ABS_LONGITUDE) | (F.abs("_lat") > MAX_ABS_LATITUDE)).alias("out_of_range_coordinate_rows"),
        F.min("_ts").alias("min_timestamp"),
        F.max("_ts").alias("max_timestamp"),
    )


def null_audit(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """Missing count and percent per column, one row per column."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__total"),
                  *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    stacked = wide.select("__total", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing_count"))
        for i, c in enumerate(cols)])).alias("s"))
    return stacked.select(
        F.col("s.column_name").alias("column_name"), F.col("s.missing_count").alias("missing_count"),
        rounded(F.try_divide(F.col("s.missing_count") * 100.0, F.col("__total")), digits).alias("pct_missing"))


def velocity_moments(raw: DataFrame) -> DataFrame:
    """Count, mean, population sd, min, max of parsed velocity."""
    v = parsed(raw).select(F.col("_velocity").alias("v"))
    return v.agg(F.count("v").alias("velocity_count"), F.avg("v").alias("velocity_mean"),
                 F.stddev_pop("v").alias("velocity_std"), F.min("v").alias("velocity_min"),
                 F.max("v").alias("velocity_max"))


def distinct_counts(df: DataFrame) -> DataFrame:
    """Distinct non-missing values of every column (G23): one de-duplication
    per column over a scan of that column alone, so no row is multiplied."""
    parts = [df.select(F.col(f"`{c}`").alias("v")).where(F.col("v").isNotNull()).distinct().agg(
        F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("distinct_count")) for c in df.columns]
    return reduce(DataFrame.unionByName, parts)


def raw_distinct_counts(raw: DataFrame) -> DataFrame:
    """Distinct values of the raw columns, valid timestamps and valid dates."""
    p = parsed(raw)
    return distinct_counts(p.select(*[F.col(f"`{c}`") for c in raw.columns], F.col("_ts").alias("valid timestamp"),
                                    F.to_date("_ts").alias("valid date")))


#: log2 of the buckets of a distinct-count sketch; its relative standard error is about 1.04 / sqrt(2 ** DISTINCT_LOG).
DISTINCT_LOG = 12


def distinct_sketches(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, column_name, sketch): a mergeable HyperLogLog state per group and
    column, to be written; states of new groups are added without the rows of
    the old ones.  Map-side aggregation leaves one state per group and task."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns]))
    long = df.select(*by, values.alias("s")).select(*by, "s.column_name", "s.v")
    return long.groupBy(*by, "column_name").agg(F.hll_sketch_agg("v", F.lit(DISTINCT_LOG)).alias("sketch"))


def distinct_estimates(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, column_name, distinct_estimate): states merged over all other columns of ``sketches``."""
    merged = sketches.groupBy(*by, "column_name").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, "column_name", F.hll_sketch_estimate("sketch").alias("distinct_estimate"))


def date_counts(clean: DataFrame) -> DataFrame:
    """Rows per valid date, ordered by date."""
    return (clean.where(F.col("date").isNotNull()).groupBy("date")
            .agg(F.count(F.lit(1)).alias("row_count")).orderBy("date"))


def segment_counts(clean: DataFrame) -> DataFrame:
    """Rows per segment, most observed first (G22); missing keys dropped."""
    return (clean.where(F.col("osm_id").isNotNull()).groupBy("osm_id")
            .agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.col("row_count").desc(), "osm_id"))


def numeric_summary(df: DataFrame, cols: list[str], by: list[str] | None = None,
                    digits: int | None = None) -> DataFrame:
    """``describe()``: count, mean, sample sd, min, exact quartiles, max per
    column (G25); with ``by`` per group as well (G26).  Long format: one row
    per (group, column)."""
    by = list(by or [])
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols]))
        .alias("s")).select(*by, "s.column_name", "s.value")
    keys = by + ["column_name"]
    moments = long.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    qs = exact_quantiles(long, keys, "value", [0.25, 0.5, 0.75], names=["p25", "p50", "p75"])
    out = moments.join(qs, keys, "left")
    return out.select(*keys, "count", *[rounded(c, digits).alias(c)
                                        for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def duplicate_report(raw: DataFrame) -> DataFrame:
    """Exact duplicate rows over all columns: groups with copies, and rows
    beyond the first copy (G27).

    128-bit fingerprints of the rows are counted first; only rows whose
    fingerprint occurs again are then grouped by their full columns, so that
    unique rows are shuffled as two numbers, and rows of equal fingerprints are
    still told apart.  Map-side combining collapses a hot group of copies."""
    cols = [F.col(f"`{c}`") for c in raw.columns]
    marks = [x for c in cols for x in (c.isNull(), c)]
    printed = raw.select(*raw.columns, F.xxhash64(F.lit(1), *marks).alias("_f1"), F.xxhash64(F.lit(2), *marks).alias("_f2"))
    again = printed.groupBy("_f1", "_f2").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1).select("_f1", "_f2")
    again = materialize(again, "repeated-fingerprints")
    rows = printed.join(again, ["_f1", "_f2"], "left_semi")
    g = rows.groupBy("_f1", "_f2", *cols).agg(F.count(F.lit(1)).alias("c"))
    return g.where(F.col("c") > 1).agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("duplicate_rows_beyond_first"))


def observed_dates(clean: DataFrame) -> DataFrame:
    """Distinct valid dates (bounded by the calendar span, not by data volume)."""
    return clean.where(F.col("date").isNotNull()).select("date").distinct()


def date_gaps(clean: DataFrame) -> DataFrame:
    """Days between consecutive observed dates (W2).  The window runs over the
    distinct-date list, whose size is the calendar span, not the row count."""
    d = observed_dates(clean)
    w = Window.orderBy("date")
    return (d.select("date", F.lag("date").over(w).alias("previous_date"))
            .where(F.col("previous_date").isNotNull())
            .select("date", "previous_date", F.datediff("date", "previous_date").cast("long").alias("gap_days")))


def largest_date_gaps(clean: DataFrame, n: int = 10) -> DataFrame:
    return date_gaps(clean).orderBy(F.col("gap_days").desc(), "date").limit(n)


def missing_dates(clean: DataFrame) -> DataFrame:
    """Calendar dates between the first and last observation with no row
    (S2 calendar via ``sequence``; S3 difference via ``left_anti``)."""
    d = observed_dates(clean)
    cal = d.agg(F.explode(F.sequence(F.min("date"), F.max("date"), F.expr("INTERVAL 1 DAY"))).alias("date"))
    return cal.join(d, "date", "left_anti").select(F.col("date").alias("missing_date")).orderBy("missing_date")


def coverage_summary(clean: DataFrame) -> DataFrame:
    """First/last date, calendar days, observed days, missing days, coverage
    rate, largest gap and gaps longer than one day (G33)."""
    d = observed_dates(clean)
    gaps = date_gaps(clean)
    base = d.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                 F.count(F.lit(1)).alias("dates_with_observations"))
    g = gaps.agg(F.max("gap_days").alias("largest_gap_between_observed_dates"),
                 F.count_if(F.col("gap_days") > 1).alias("gaps_longer_than_one_day"))
    cal = (F.datediff("last_date", "first_date") + 1).cast("long")
    return base.select(
        "first_date", "last_date", cal.alias("calendar_days_in_range"), "dates_with_observations",
        (cal - F.col("dates_with_observations")).alias("missing_calendar_dates"),
        (F.col("dates_with_observations") / cal).alias("coverage_rate"),
        F.coalesce(g.select("largest_gap_between_observed_dates").scalar(), F.lit(0)).cast("long")
        .alias("largest_gap_between_observed_dates"),
        g.select("gaps_longer_than_one_day").scalar().alias("gaps_longer_than_one_day"),
    )


def timestamp_gap_multiset(clean: DataFrame) -> DataFrame:
    """Gaps (seconds) between consecutive sorted timestamps as weighted rows
    (gap, weight), at any resolution of the timestamps.

    A global ``lag`` would sort every row in one task.  Here the distinct
    timestamps are range-partitioned, each range looks back inside itself, and
    the last timestamp of the ranges before comes from a table of one row per
    range.  A repeated timestamp adds as many gaps of zero as it has further
    copies."""
    distinct = clean.where(F.col("timestamp").isNotNull()).groupBy("timestamp").agg(F.count(F.lit(1)).alias("c"))
    rows = running(distinct, [], [F.col("timestamp").asc()], lasts={"prev": F.col("timestamp")}, before=True)
    one, micros = F.lit(1).cast("long"), F.timestamp_diff("MICROSECOND", "prev", "timestamp")
    parts = F.array(F.struct(F.when(F.col("prev").isNotNull(), micros / 1e6).alias("gap"), one.alias("weight")),
                    F.struct(F.lit(0.0).alias("gap"), (F.col("c") - 1).alias("weight")))
    return rows.select(F.inline(parts)).where(F.col("gap").isNotNull() & (F.col("weight") > 0)).groupBy("gap").agg(F.sum("weight").alias("weight"))


def timestamp_gaps(clean: DataFrame, digits: int | None = None) -> DataFrame:
    """``describe()`` of the gaps between consecutive sorted timestamps (W1):
    count, mean, sample sd, min, exact quartiles, max."""
    # one row per distinct gap, written once for the passes below
    g = materialize(timestamp_gap_multiset(clean), "timestamp-gaps")
    m = g.agg(F.sum("weight").alias("n"), F.sum(F.col("gap") * F.col("weight")).alias("s"),
              F.min("gap").alias("min"), F.max("gap").alias("max"))
    mean = m.select(F.col("s") / F.col("n")).scalar()
    ss = g.agg(F.sum((F.col("gap") - mean) * (F.col("gap") - mean) * F.col("weight"))).scalar()
    q = exact_quantiles(g, [], "gap", [0.25, 0.5, 0.75], names=["p25", "p50", "p75"], weight="weight")
    var = F.try_divide(ss, F.col("n") - 1)
    stats = m.select(F.col("n").cast("long").alias("count"), mean.alias("mean"), F.sqrt(var).alias("std"),
                     "min", "max")
    quartiles = q.select(F.struct("p25", "p50", "p75")).scalar()  # one (reused) subquery
    out = stats.select("count", "mean", "std", "min", quartiles.getField("p25").alias("p25"),
                       quartiles.getField("p50").alias("p50"), quartiles.getField("p75").alias("p75"), "max")
    return out.select("count", *[rounded(c, digits).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")])


def near_zero_report(obs: DataFrame, near: float = NEAR_ZERO_VELOCITY, slow: float = SLOW_VELOCITY,
                     digits: int | None = 2) -> DataFrame:
    """Exact zeros, near-zero (< near) and slow (< slow) velocities with shares,
    and the smallest velocity (G32, F9)."""
    v = F.col("velocity")
    a = obs.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(v == 0).alias("zero_exact"),
                F.count_if(v < near).alias("near_zero"), F.count_if(v < slow).alias("below_slow"),
                F.min(v).alias("min_velocity"))
    pct = lambda c: rounded(F.try_divide(F.col(c) * 100.0, F.col("total_rows")), digits)
    return a.select("total_rows", "zero_exact", pct("zero_exact").alias("pct_zero_exact"),
                    "near_zero", pct("near_zero").alias("pct_near_zero"),
                    "below_slow", pct("below_slow").alias("pct_below_slow"), "min_velocity")


def near_zero_by_hour(obs: DataFrame, near: float = NEAR_ZERO_VELOCITY, digits: int | None = 2) -> DataFrame:
    """Near-zero rows per hour and their share of all near-zero rows."""
    nz = obs.where(F.col("velocity") < near)
    by = nz.groupBy(F.col("hour").cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("near_zero_count"))
    total = by.agg(F.sum("near_zero_count")).scalar()
    return by.where(F.col("hour").isNotNull()).select("hour", "near_zero_count",
                     rounded(F.try_divide(F.col("near_zero_count") * 100.0, total), digits)
                     .alias("pct_of_all_near_zeros")).orderBy("hour")


def near_zero_by_segment(obs: DataFrame, near: float = NEAR_ZERO_VELOCITY, n: int = 20,
                         digits: int | None = 2) -> DataFrame:
    """Segments with the most near-zero rows (top n) and their share."""
    nz = obs.where(F.col("velocity") < near)
    by = nz.groupBy("osm_id").agg(F.count(F.lit(1)).alias("near_zero_count"))
    total = by.agg(F.sum("near_zero_count")).scalar()
    top = by.where(F.col("osm_id").isNotNull()).orderBy(F.col("near_zero_count").desc(), "osm_id").limit(n)
    return top.select("osm_id", "near_zero_count",
                      rounded(F.try_divide(F.col("near_zero_count") * 100.0, total), digits)
                      .alias("pct_of_all_near_zeros"))


def near_zero_segments(obs: DataFrame, near: float = NEAR_ZERO_VELOCITY, digits: int | None = 2) -> DataFrame:
    """Segments with at least one near-zero row, of all segments."""
    by = obs.where(F.col("osm_id").isNotNull()).groupBy("osm_id").agg(F.coalesce(F.max(F.col("velocity") < near), F.lit(False)).alias("any"))
    a = by.agg(F.count_if("any").alias("segments_with_near_zero"), F.count(F.lit(1)).alias("segments"))
    return a.select("segments_with_near_zero", "segments",
                    rounded(F.try_divide(F.col("segments_with_near_zero") * 100.0, F.col("segments")), digits).alias("pct_of_segments"))
