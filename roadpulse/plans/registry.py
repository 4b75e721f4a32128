"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame`` per
operator, and, where SQL can express it, an independent DuckDB oracle string.

Fixture choices (documented in README): the supplied ``events`` table has 30
days and ~20-70 rows per segment-hour at sf0.01, so support thresholds are set
per query to keep results non-empty; the operators' defaults remain the
analysed workload's values.  Checked queries round to ``DIGITS`` decimals on
both sides so float summation order does not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from roadpulse.functions.columns import rounded
from roadpulse.operators import daily as D
from roadpulse.operators import slowdown as S
from roadpulse.plans import oracle as O
from roadpulse.sources import fixtures as X

DIGITS = 6

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle.strip()
        return fn
    return deco


def _dense(spark, sf):
    return X.observations(spark, sf, "dense")


def _sparse(spark, sf):
    return X.observations(spark, sf, "sparse")


def R(expr: str, digits: int = DIGITS) -> str:
    """DuckDB side of ``functions.rounded``: float noise beyond 12 decimals off, then HALF_UP in decimal."""
    return f"CAST(ROUND(CAST(ROUND({expr}, 12) AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def present(df: DataFrame) -> DataFrame:
    """Registered outputs show DATE columns as ISO text (as the analysed
    workload exported them), so both engines hand over identical values."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import DateType
    return df.select(*[F.date_format(f.name, "yyyy-MM-dd").alias(f.name) if isinstance(f.dataType, DateType)
                       else F.col(f.name) for f in df.schema.fields])


# --------------------------------------------------------------------------
# Daily summary
# --------------------------------------------------------------------------
@query("daily_segment_hour", f"""
WITH {O.obs_cte('dense')}, {O.daily_cte(2)}
SELECT osm_id, CAST(observation_date AS VARCHAR) AS observation_date, hour, daily_observation_count,
       {R('daily_average_velocity')} AS daily_average_velocity
FROM daily_segment_hour""")
def q_daily_segment_hour(spark, sf):
    d = D.daily_segment_hour(_dense(spark, sf), min_daily_obs=2)
    return present(d.withColumn("daily_average_velocity", rounded("daily_average_velocity", DIGITS)))


@query("daily_summary_check", f"""
WITH {O.obs_cte('dense')}, {O.daily_cte(2)}
SELECT COUNT(*) AS summary_rows, COUNT(DISTINCT osm_id) AS segments,
       CAST(MIN(observation_date) AS VARCHAR) AS first_date, CAST(MAX(observation_date) AS VARCHAR) AS last_date
FROM daily_segment_hour""")
def q_daily_summary_check(spark, sf):
    return present(D.daily_summary_check(D.daily_segment_hour(_dense(spark, sf), min_daily_obs=2)))


# --------------------------------------------------------------------------
# Slowdown family
# --------------------------------------------------------------------------
@query("relative_slowdowns", f"""
WITH {O.obs_cte('dense')},
cells AS (SELECT osm_id, hour, COUNT(*) AS n, SUM(velocity) AS total, COUNT(velocity) AS present FROM observations GROUP BY ALL),
compared AS (
    SELECT osm_id, hour, n, total / NULLIF(present, 0) AS here,
           SUM(total) OVER whole / NULLIF(SUM(present) OVER whole, 0) AS usual
    FROM cells WINDOW whole AS (PARTITION BY osm_id))
SELECT osm_id, hour, n AS observation_count, {R('here')} AS hourly_velocity, {R('usual')} AS baseline_velocity,
       {R('here - usual')} AS velocity_difference
FROM compared WHERE n >= 15 ORDER BY here - usual, osm_id, hour LIMIT 50""")
def q_relative_slowdowns(spark, sf):
    return S.relative_slowdowns(_dense(spark, sf), min_obs=15, n=50, digits=DIGITS)


@query("recurring_slowdowns", f"""
WITH {O.obs_cte('dense')}, {O.daily_cte(2)},
usual AS (SELECT osm_id, SUM(velocity) / NULLIF(COUNT(velocity), 0) AS v FROM observations GROUP BY osm_id)
SELECT * FROM (
    SELECT osm_id, hour, COUNT(*) AS observed_days, CAST(SUM(daily_observation_count) AS BIGINT) AS total_observations,
           {R('AVG(daily_average_velocity)')} AS average_daily_velocity, {R('ANY_VALUE(v)')} AS baseline_velocity,
           {R('AVG(daily_average_velocity) - ANY_VALUE(v)')} AS velocity_difference,
           {R('MAX(daily_average_velocity)')} AS maximum_daily_velocity,
           {R(f"SQRT(GREATEST({R('VAR_POP(daily_average_velocity)')}, 0))")} AS daily_velocity_std
    FROM daily_segment_hour JOIN usual USING (osm_id) GROUP BY osm_id, hour HAVING COUNT(*) >= 5)
ORDER BY velocity_difference, osm_id, hour LIMIT 50""")
def q_recurring_slowdowns(spark, sf):
    obs = _dense(spark, sf)
    return S.recurring_slowdowns(D.daily_segment_hour(obs, 2), obs=obs, min_days=5, n=50, digits=DIGITS)


@query("weekday_weekend", f"""
WITH {O.obs_cte('dense')}, {O.daily_cte(2)},
sides AS (
    SELECT osm_id, hour,
           COUNT(*) FILTER (isodow(observation_date) <= 5) AS weekday_days,
           COUNT(*) FILTER (isodow(observation_date) > 5) AS weekend_days,
           AVG(daily_average_velocity) FILTER (isodow(observation_date) <= 5) AS on_weekdays,
           AVG(daily_average_velocity) FILTER (isodow(observation_date) > 5) AS on_weekends
    FROM daily_segment_hour GROUP BY osm_id, hour)
SELECT osm_id, hour, weekday_days, weekend_days, {R('on_weekdays')} AS weekday_velocity,
       {R('on_weekends')} AS weekend_velocity, {R('on_weekdays - on_weekends')} AS weekday_minus_weekend
FROM sides WHERE LEAST(weekday_days, weekend_days) >= 2
ORDER BY on_weekdays - on_weekends, osm_id, hour LIMIT 30""")
def q_weekday_weekend(spark, sf):
    return S.weekday_weekend(D.daily_segment_hour(_dense(spark, sf), 2), min_days=2, n=30, digits=DIGITS)


def bottleneck_sql(segment: str, min_daily: int, days: int, nobs: int, digits: int = DIGITS) -> str:
    """Every cell carries its segment's mean over all daily rows; the rest is a filter."""
    r = lambda e: R(e, digits)
    return f"""
WITH {O.obs_cte(segment)}, {O.daily_cte(min_daily)},
rows_with_mean AS (
    SELECT *, AVG(daily_average_velocity) OVER (PARTITION BY osm_id) AS usual FROM daily_segment_hour),
cells AS (
    SELECT osm_id, hour, COUNT(*) AS days, CAST(SUM(daily_observation_count) AS BIGINT) AS seen, ANY_VALUE(usual) AS usual,
           AVG(daily_average_velocity) AS here, VAR_POP(daily_average_velocity) AS spread
    FROM rows_with_mean GROUP BY osm_id, hour)
SELECT osm_id, hour, days AS observed_days, seen AS total_observations, {r('here')} AS average_daily_velocity,
       {r('usual')} AS baseline_velocity, {r('usual - here')} AS velocity_drop,
       {r('100.0 * (usual - here) / usual')} AS slowdown_percentage, {r(f"SQRT(GREATEST({r('spread')}, 0))")} AS daily_velocity_std
FROM cells WHERE days >= {days} AND seen >= {nobs} AND usual > 0 AND here < usual
ORDER BY slowdown_percentage DESC, observed_days DESC, osm_id, hour LIMIT 30"""


@query("candidate_bottlenecks", bottleneck_sql("dense", 1, 5, 10))
def q_candidate_bottlenecks(spark, sf):
    return S.candidate_bottlenecks(D.daily_segment_hour(_dense(spark, sf), 1), min_days=5, min_obs=10,
                                   n=30, digits=DIGITS)


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: candidate bottleneck ranking on the sparse fixture."""
    return S.candidate_bottlenecks(D.daily_segment_hour(_sparse(spark, sf_dir), 1), min_days=3, min_obs=3,
                                   n=30, digits=2)


# ==========================================================================
# Wider coverage.  Imports kept here so each family reads top to bottom.
# ==========================================================================
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.types import DoubleType  # noqa: E402

from roadpulse.operators import cluster as C  # noqa: E402
from roadpulse.operators import features as FE  # noqa: E402
from roadpulse.operators import insights as IN  # noqa: E402
from roadpulse.operators import profiles as P  # noqa: E402
from roadpulse.operators import quality as Q  # noqa: E402
from roadpulse.params import ClusterParams  # noqa: E402
from roadpulse.session import materialize  # noqa: E402
from roadpulse.sources import raw as RAW  # noqa: E402

rnd = O.rnd


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*[rounded(f.name, digits).alias(f.name) if isinstance(f.dataType, DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def _raw(spark, sf):
    return X.raw_text(spark, sf)


def _clean(spark, sf):
    return RAW.clean(X.raw_text(spark, sf))


OBS_D = O.obs_cte("dense")
OBS_S = O.obs_cte("sparse")
RAWC = O.RAW_CTE
CLEANC = f"{O.RAW_CTE}, {O.CLEAN_CTE}"


# -------------------------------- profiles (G1-G6, G10, G12, G28-G31) -----
@query("table_summary", f"""
WITH {OBS_D}
SELECT COUNT(*) AS total_row_count, MIN(timestamp) AS min_timestamp, MAX(timestamp) AS max_timestamp
FROM observations""")
def q_table_summary(spark, sf):
    return P.table_summary(_dense(spark, sf))


@query("hourly_profile", f"""
WITH {OBS_D}
SELECT hour, COUNT(*) AS total_row_count, {rnd('AVG(velocity)')} AS average_velocity
FROM observations GROUP BY hour ORDER BY hour""")
def q_hourly_profile(spark, sf):
    return P.hourly_profile(_dense(spark, sf), digits=DIGITS)


_SEG_PROFILE = """
WITH {obs}
SELECT osm_id, COUNT(*) AS total_row_count, {avg} AS average_velocity,
       {mn} AS minimum_velocity, {mx} AS maximum_velocity
FROM observations GROUP BY osm_id {having}
ORDER BY {order}, osm_id LIMIT 20"""


@query("segment_profile", _SEG_PROFILE.format(obs=OBS_D, avg=rnd("AVG(velocity)"), mn=rnd("MIN(velocity)"),
                                              mx=rnd("MAX(velocity)"), having="",
                                              order="total_row_count DESC"))
def q_segment_profile(spark, sf):
    return P.segment_profile(_dense(spark, sf), n=20, digits=DIGITS)


@query("low_velocity_screen", _SEG_PROFILE.format(obs=OBS_D, avg=rnd("AVG(velocity)"), mn=rnd("MIN(velocity)"),
                                                  mx=rnd("MAX(velocity)"), having="HAVING COUNT(*) >= 400",
                                                  order="AVG(velocity) ASC"))
def q_low_velocity_screen(spark, sf):
    return P.low_velocity_screen(_dense(spark, sf), min_obs=400, n=20, digits=DIGITS)


@query("segment_baseline", f"""
WITH {OBS_D}
SELECT osm_id, {rnd('AVG(velocity)')} AS baseline_velocity FROM observations GROUP BY osm_id""")
def q_segment_baseline(spark, sf):
    return round_doubles(S.observation_baseline(_dense(spark, sf)))


@query("date_weighted_baseline", f"""
WITH {OBS_D}, {O.daily_cte(2)}
SELECT osm_id, {rnd('AVG(daily_average_velocity)')} AS baseline_velocity FROM daily_segment_hour GROUP BY osm_id""")
def q_date_weighted_baseline(spark, sf):
    return round_doubles(S.date_weighted_baseline(D.daily_segment_hour(_dense(spark, sf), 2)))


@query("day_type_profile", f"""
WITH {OBS_D}, {O.daily_cte(2)}
SELECT osm_id, hour,
       CASE WHEN strftime(observation_date, '%w') IN ('0', '6') THEN 'weekend' ELSE 'weekday' END AS day_type,
       COUNT(*) AS observed_days, {rnd('AVG(daily_average_velocity)')} AS average_daily_velocity
FROM daily_segment_hour GROUP BY ALL HAVING COUNT(*) >= 2""")
def q_day_type_profile(spark, sf):
    return round_doubles(S.day_type_profile(D.daily_segment_hour(_dense(spark, sf), 2), min_days=2))


@query("hourly_date_stats", f"""
WITH {OBS_D}
SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, hour, day_of_week,
       COUNT(velocity) AS observation_count, {rnd('SUM(velocity)')} AS velocity_sum,
       {rnd('MIN(velocity)')} AS velocity_min, {rnd('MAX(velocity)')} AS velocity_max,
       {rnd('SUM(velocity) / COUNT(velocity)')} AS velocity_mean
FROM observations GROUP BY ALL""")
def q_hourly_date_stats(spark, sf):
    return present(round_doubles(P.hourly_date_stats(_dense(spark, sf))))


@query("segment_stats", f"""
WITH {OBS_D}
SELECT osm_id, COUNT(velocity) AS observation_count, {rnd('SUM(velocity)')} AS velocity_sum,
       {rnd('MIN(velocity)')} AS velocity_min, {rnd('MAX(velocity)')} AS velocity_max,
       {rnd('SUM(velocity) / COUNT(velocity)')} AS velocity_mean
FROM observations GROUP BY osm_id""")
def q_segment_stats(spark, sf):
    return round_doubles(P.segment_stats(_dense(spark, sf)))


@query("hour_date_rollup", f"""
WITH {OBS_D},
hourly AS (SELECT CAST(timestamp AS DATE) AS date, hour, day_of_week, COUNT(velocity) AS observation_count,
                  SUM(velocity) AS velocity_sum FROM observations GROUP BY ALL)
SELECT CASE WHEN GROUPING(hour) = 0 THEN 'hour' ELSE 'date' END AS level, hour,
       CAST(date AS VARCHAR) AS date, CAST(SUM(observation_count) AS BIGINT) AS observation_count,
       {rnd('SUM(velocity_sum)')} AS velocity_sum, {rnd('SUM(velocity_sum) / SUM(observation_count)')} AS velocity_mean
FROM hourly GROUP BY GROUPING SETS ((hour), (date))""")
def q_hour_date_rollup(spark, sf):
    return present(round_doubles(P.hour_date_rollup(P.hourly_date_stats(_dense(spark, sf)))))


@query("top_segment_share", f"""
WITH {OBS_D}, c AS (SELECT osm_id, COUNT(*) AS c FROM observations GROUP BY osm_id),
top AS (SELECT c FROM c ORDER BY c DESC, osm_id LIMIT 20)
SELECT 20 AS top_n, CAST((SELECT SUM(c) FROM top) AS BIGINT) AS top_rows,
       CAST((SELECT SUM(c) FROM c) AS BIGINT) AS total_rows,
       {rnd('CAST((SELECT SUM(c) FROM top) AS DOUBLE) / (SELECT SUM(c) FROM c)')} AS share""")
def q_top_segment_share(spark, sf):
    return round_doubles(P.top_segment_share(_dense(spark, sf), n=20))


# -------------------------------- cleaning and quality (raw text view) ----
@query("clean_observations", f"""
WITH {CLEANC}
SELECT timestamp, CAST(date AS VARCHAR) AS date, year, month, day_of_week, hour, longitude, latitude,
       course, velocity, osm_id FROM clean""")
def q_clean_observations(spark, sf):
    return present(_clean(spark, sf))


@query("validity_report", f"""
WITH {RAWC}
SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE _ts IS NULL) AS invalid_timestamp_rows,
       COUNT(*) FILTER (WHERE _lon IS NULL OR _lat IS NULL OR abs(_lon) > 180 OR abs(_lat) > 90)
           AS invalid_coordinate_rows,
       COUNT(*) FILTER (WHERE _lon = 0 OR _lat = 0) AS zero_coordinate_rows,
       COUNT(*) FILTER (WHERE abs(_lon) > 180 OR abs(_lat) > 90) AS out_of_range_coordinate_rows,
       MIN(_ts) AS min_timestamp, MAX(_ts) AS max_timestamp
FROM parsed""")
def q_validity_report(spark, sf):
    return Q.validity_report(_raw(spark, sf))


_RAW_COLS = ["Date", "Time", "Coordinate (Lon, Lat)", "Course", "Velocity", "OSM ID"]


@query("null_audit", f"""
WITH {RAWC}, t AS (SELECT COUNT(*) AS n FROM raw),
m AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE \"{c}\" IS NULL) AS missing_count FROM raw" for c in _RAW_COLS)})
SELECT column_name, missing_count, {rnd('missing_count * 100.0 / n')} AS pct_missing FROM m, t""")
def q_null_audit(spark, sf):
    return Q.null_audit(_raw(spark, sf), digits=DIGITS)


@query("velocity_moments", f"""
WITH {RAWC}
SELECT COUNT(_velocity) AS velocity_count, {rnd('AVG(_velocity)')} AS velocity_mean,
       {rnd('STDDEV_POP(_velocity)')} AS velocity_std, {rnd('MIN(_velocity)')} AS velocity_min,
       {rnd('MAX(_velocity)')} AS velocity_max FROM parsed""")
def q_velocity_moments(spark, sf):
    return round_doubles(Q.velocity_moments(_raw(spark, sf)))


@query("distinct_counts", f"""
WITH {RAWC}
{' UNION ALL '.join(f"SELECT '{c}' AS column_name, COUNT(DISTINCT \"{c}\") AS distinct_count FROM parsed" for c in _RAW_COLS)}
UNION ALL SELECT 'valid timestamp', COUNT(DISTINCT _ts) FROM parsed
UNION ALL SELECT 'valid date', COUNT(DISTINCT CAST(_ts AS DATE)) FROM parsed""")
def q_distinct_counts(spark, sf):
    return Q.raw_distinct_counts(_raw(spark, sf))


_SKETCHED = ("timestamp", "velocity", "osm_id")
_ERROR = 4 * 1.04 / 2 ** (Q.DISTINCT_LOG / 2)  # four standard errors


def _exact_by(source: str, by: str) -> str:
    return " UNION ALL ".join(f"SELECT {by}, '{c}' AS column_name, COUNT(DISTINCT {c}) AS distinct_count FROM {source} GROUP BY ALL" for c in _SKETCHED)


@query("distinct_sketches", f"""
WITH {CLEANC}, days AS (SELECT * FROM clean WHERE date IS NOT NULL)
SELECT level, date, column_name, distinct_count, TRUE AS estimate_within_error FROM (
  SELECT 'date' AS level, CAST(date AS VARCHAR) AS date, column_name, distinct_count FROM ({_exact_by('days', 'date')})
  UNION ALL SELECT 'all', NULL, column_name, distinct_count FROM ({_exact_by('days', "'all'")}))""")
def q_distinct_sketches(spark, sf):
    """Sketches written per date, merged over all dates, each beside the exact count."""
    days = _clean(spark, sf).where(F.col("date").isNotNull())
    sketches = materialize(Q.distinct_sketches(days, ["date"], list(_SKETCHED)), "distinct-sketches")
    exact = [days.select("date", F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")).where(F.col("v").isNotNull()) for c in _SKETCHED]
    values = reduce(DataFrame.unionByName, exact)
    per_date = values.distinct().groupBy("date", "column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    whole = values.drop("date").distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    by_date = per_date.join(Q.distinct_estimates(sketches, ["date"]), ["date", "column_name"]).withColumn("level", F.lit("date"))
    total = whole.join(Q.distinct_estimates(sketches, []), "column_name").select(F.lit(None).cast("date").alias("date"), "*", F.lit("all").alias("level"))
    near = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= F.greatest(F.lit(2.0), _ERROR * F.col("distinct_count"))
    return present(by_date.unionByName(total).select("level", "date", "column_name", "distinct_count", near.alias("estimate_within_error")))


@query("near_zero_segments", f"""
WITH {OBS_S}, s AS (SELECT osm_id, bool_or(velocity < 0.1) AS near FROM observations GROUP BY osm_id)
SELECT COUNT(*) FILTER (WHERE near) AS segments_with_near_zero, COUNT(*) AS segments,
       {rnd('COUNT(*) FILTER (WHERE near) * 100.0 / COUNT(*)')} AS pct_of_segments FROM s""")
def q_near_zero_segments(spark, sf):
    return Q.near_zero_segments(_sparse(spark, sf), digits=DIGITS)


@query("date_counts", f"""
WITH {CLEANC}
SELECT CAST(date AS VARCHAR) AS date, COUNT(*) AS row_count FROM clean WHERE date IS NOT NULL
GROUP BY date ORDER BY date""")
def q_date_counts(spark, sf):
    return present(Q.date_counts(_clean(spark, sf)))


@query("segment_counts", f"""
WITH {CLEANC}
SELECT osm_id, COUNT(*) AS row_count FROM clean WHERE osm_id IS NOT NULL GROUP BY osm_id
ORDER BY row_count DESC, osm_id""")
def q_segment_counts(spark, sf):
    return Q.segment_counts(_clean(spark, sf))


def _describe_sql(source: str, cols: list[str], by: str | None = None) -> str:
    byc = f"{by}, " if by else ""
    unp = " UNION ALL ".join(f"SELECT {byc}'{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM {source}"
                             for c in cols)
    return f"""long AS ({unp})
SELECT {byc}column_name, COUNT(value) AS count, {rnd('AVG(value)')} AS mean, {rnd('STDDEV_SAMP(value)')} AS std,
       {rnd('MIN(value)')} AS min, {rnd('quantile_cont(value, 0.25)')} AS p25,
       {rnd('quantile_cont(value, 0.5)')} AS p50, {rnd('quantile_cont(value, 0.75)')} AS p75,
       {rnd('MAX(value)')} AS max
FROM long GROUP BY {byc}column_name"""


@query("numeric_summary", f"WITH {CLEANC}, {_describe_sql('clean', ['course', 'velocity'])}")
def q_numeric_summary(spark, sf):
    return Q.numeric_summary(_clean(spark, sf), ["course", "velocity"], digits=DIGITS)


@query("duplicate_report", f"""
WITH {RAWC}, g AS (SELECT "Date", "Time", "Coordinate (Lon, Lat)", "Course", "Velocity", "OSM ID", COUNT(*) AS c
                   FROM raw GROUP BY ALL HAVING COUNT(*) > 1)
SELECT COUNT(*) AS duplicate_groups, CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS duplicate_rows_beyond_first FROM g""")
def q_duplicate_report(spark, sf):
    return Q.duplicate_report(_raw(spark, sf))


_DATES = "d AS (SELECT DISTINCT date FROM clean WHERE date IS NOT NULL)"
_GAPS = "gaps AS (SELECT date, lag(date) OVER (ORDER BY date) AS previous_date FROM d)"


@query("coverage_summary", f"""
WITH {CLEANC}, {_DATES}, {_GAPS},
b AS (SELECT MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) AS n FROM d),
g AS (SELECT MAX(date - previous_date) AS largest, COUNT(*) FILTER (WHERE date - previous_date > 1) AS longer
      FROM gaps WHERE previous_date IS NOT NULL)
SELECT CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date,
       CAST(last_date - first_date + 1 AS BIGINT) AS calendar_days_in_range, n AS dates_with_observations,
       CAST(last_date - first_date + 1 - n AS BIGINT) AS missing_calendar_dates,
       n / CAST(last_date - first_date + 1 AS DOUBLE) AS coverage_rate,
       CAST(COALESCE(largest, 0) AS BIGINT) AS largest_gap_between_observed_dates,
       longer AS gaps_longer_than_one_day
FROM b, g""")
def q_coverage_summary(spark, sf):
    return present(Q.coverage_summary(_clean(spark, sf)))


@query("missing_dates", f"""
WITH {CLEANC}, {_DATES},
cal AS (SELECT CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d)
SELECT CAST(date AS VARCHAR) AS missing_date FROM cal WHERE date NOT IN (SELECT date FROM d) ORDER BY 1""")
def q_missing_dates(spark, sf):
    return present(Q.missing_dates(_clean(spark, sf)))


@query("date_gaps", f"""
WITH {CLEANC}, {_DATES}, {_GAPS}
SELECT CAST(date AS VARCHAR) AS date, CAST(previous_date AS VARCHAR) AS previous_date,
       CAST(date - previous_date AS BIGINT) AS gap_days
FROM gaps WHERE previous_date IS NOT NULL""")
def q_date_gaps(spark, sf):
    return present(Q.date_gaps(_clean(spark, sf)))


@query("timestamp_gaps", f"""
WITH {CLEANC},
g AS (SELECT epoch(timestamp) - epoch(lag(timestamp) OVER (ORDER BY timestamp)) AS gap
      FROM clean WHERE timestamp IS NOT NULL)
SELECT COUNT(gap) AS count, {rnd('AVG(gap)')} AS mean, {rnd('STDDEV_SAMP(gap)')} AS std, {rnd('MIN(gap)')} AS min,
       {rnd('quantile_cont(gap, 0.25)')} AS p25, {rnd('quantile_cont(gap, 0.5)')} AS p50,
       {rnd('quantile_cont(gap, 0.75)')} AS p75, {rnd('MAX(gap)')} AS max
FROM g""")
def q_timestamp_gaps(spark, sf):
    return Q.timestamp_gaps(_clean(spark, sf), digits=DIGITS)


@query("timestamp_gaps_full_precision", f"""
WITH g AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts))) / 1e6 AS gap FROM events WHERE ts IS NOT NULL)
SELECT COUNT(gap) AS count, {rnd('AVG(gap)')} AS mean, {rnd('STDDEV_SAMP(gap)')} AS std, {rnd('MIN(gap)')} AS min,
       {rnd('quantile_cont(gap, 0.25)')} AS p25, {rnd('quantile_cont(gap, 0.5)')} AS p50,
       {rnd('quantile_cont(gap, 0.75)')} AS p75, {rnd('MAX(gap)')} AS max
FROM g""")
def q_timestamp_gaps_full_precision(spark, sf):
    ts = X.events(spark, sf).select(F.col("ts").cast("timestamp_ntz").alias("timestamp"))
    return Q.timestamp_gaps(ts, digits=DIGITS)


# -------------------------------- near-zero velocities (G32, F9, W4) ------
@query("near_zero_report", f"""
WITH {OBS_D}, a AS (
    SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (WHERE velocity = 0) AS zero_exact,
           COUNT(*) FILTER (WHERE velocity < 0.1) AS near_zero, COUNT(*) FILTER (WHERE velocity < 1.0) AS below_slow,
           MIN(velocity) AS min_velocity FROM observations)
SELECT total_rows, zero_exact, {rnd('zero_exact * 100.0 / total_rows')} AS pct_zero_exact,
       near_zero, {rnd('near_zero * 100.0 / total_rows')} AS pct_near_zero,
       below_slow, {rnd('below_slow * 100.0 / total_rows')} AS pct_below_slow, min_velocity FROM a""")
def q_near_zero_report(spark, sf):
    return Q.near_zero_report(_dense(spark, sf), digits=DIGITS)


@query("near_zero_by_hour", f"""
WITH {OBS_D}, h AS (SELECT hour, COUNT(*) AS near_zero_count FROM observations WHERE velocity < 0.1 GROUP BY hour)
SELECT hour, near_zero_count, {rnd('near_zero_count * 100.0 / (SELECT SUM(near_zero_count) FROM h)')}
       AS pct_of_all_near_zeros FROM h WHERE hour IS NOT NULL ORDER BY hour""")
def q_near_zero_by_hour(spark, sf):
    return Q.near_zero_by_hour(_dense(spark, sf), digits=DIGITS)


@query("near_zero_by_segment", f"""
WITH {OBS_D}, s AS (SELECT osm_id, COUNT(*) AS near_zero_count FROM observations WHERE velocity < 0.1 GROUP BY osm_id)
SELECT osm_id, near_zero_count, {rnd('near_zero_count * 100.0 / (SELECT SUM(near_zero_count) FROM s)')}
       AS pct_of_all_near_zeros FROM s WHERE osm_id IS NOT NULL ORDER BY near_zero_count DESC, osm_id LIMIT 20""")
def q_near_zero_by_segment(spark, sf):
    return Q.near_zero_by_segment(_dense(spark, sf), n=20, digits=DIGITS)


# -------------------------------- features (C5, C11, G13-G18, G34, G41) ---
# sparse fixture: one segment per user.  Feature table: daily >= 2 rows,
# >= 60 observations and >= 25 active days (exercises the NULL path: few
# segments have every peak column).  Clustering fixture: daily >= 1, 40 / 20.
FEAT = dict(min_daily=2, min_obs=60, min_days=25)
CLUS = dict(min_daily=1, min_obs=40, min_days=20)


def _features(spark, sf, min_daily, min_obs, min_days):
    """The feature table, written and read back (the analysed workload hands it
    to the clustering stage as a file too)."""
    def build():
        obs = _sparse(spark, sf)
        return FE.segment_features(obs, D.daily_segment_hour(obs, min_daily), min_obs=min_obs,
                                   min_active_days=min_days, digits=DIGITS)
    return materialize(build(), "segment-features")


_COV_SQL = f"""{OBS_S}, cov AS (
    SELECT osm_id, COUNT(*) AS observation_count, COUNT(DISTINCT CAST(timestamp AS DATE)) AS active_days,
           CAST(SUM(CASE WHEN velocity < 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS zero_velocity_observation_count
    FROM observations GROUP BY osm_id)"""


@query("segment_coverage", f"WITH {_COV_SQL} SELECT osm_id, observation_count, active_days FROM cov")
def q_segment_coverage(spark, sf):
    return FE.segment_coverage(_sparse(spark, sf)).select("osm_id", "observation_count", "active_days")


@query("segment_counts_diag", f"WITH {_COV_SQL} SELECT * FROM cov")
def q_segment_counts_diag(spark, sf):
    return FE.segment_coverage(_sparse(spark, sf))


@query("threshold_grid", f"""
WITH {_COV_SQL}, grid AS (SELECT * FROM (VALUES {', '.join(f'({a}, {b})' for a in (50, 100, 200, 500) for b in (5, 10, 20, 30))})
                             AS t(min_observations, min_active_days))
SELECT min_observations, min_active_days,
       (SELECT COUNT(*) FROM cov WHERE observation_count >= min_observations AND active_days >= min_active_days)
           AS surviving_segments,
       {rnd('(SELECT COUNT(*) FROM cov WHERE observation_count >= min_observations AND active_days >= min_active_days) * 100.0 / (SELECT COUNT(*) FROM cov)')}
           AS pct_of_total
FROM grid""")
def q_threshold_grid(spark, sf):
    return FE.threshold_grid(FE.segment_coverage(_sparse(spark, sf)), digits=DIGITS)


@query("coverage_histogram", f"""
WITH {_COV_SQL},
m AS (SELECT 'observation_count' AS measure, CAST(observation_count AS DOUBLE) AS x FROM cov
      UNION ALL SELECT 'active_days', CAST(active_days AS DOUBLE) FROM cov),
e AS (SELECT measure, CASE WHEN MAX(x) > MIN(x) THEN MIN(x) ELSE MIN(x) - 0.5 END AS lo,
             CASE WHEN MAX(x) > MIN(x) THEN MAX(x) ELSE MAX(x) + 0.5 END AS hi FROM m GROUP BY measure),
b AS (SELECT m.measure, CAST(LEAST(FLOOR((x - lo) * 100 / (hi - lo)), 99) AS INTEGER) AS bin
      FROM m JOIN e ON m.measure = e.measure),
c AS (SELECT measure, bin, COUNT(*) AS segments FROM b GROUP BY ALL),
g AS (SELECT measure, lo, hi, CAST(unnest(range(0, 100)) AS INTEGER) AS bin FROM e)
SELECT g.measure, g.bin, {rnd('lo + g.bin * (hi - lo) / 100')} AS bin_start,
       {rnd('lo + (g.bin + 1) * (hi - lo) / 100')} AS bin_end, COALESCE(c.segments, 0) AS segments
FROM g LEFT JOIN c ON g.measure = c.measure AND g.bin = c.bin""")
def q_coverage_histogram(spark, sf):
    return round_doubles(FE.coverage_histogram(FE.segment_coverage(_sparse(spark, sf))))


@query("moving_velocity_stats", f"""
WITH {OBS_S}
SELECT osm_id, {rnd('median(velocity)')} AS median_velocity, {rnd('stddev_samp(velocity)')} AS velocity_std
FROM observations WHERE velocity >= 0.1 GROUP BY osm_id""")
def q_moving_velocity_stats(spark, sf):
    return FE.moving_velocity_stats(_sparse(spark, sf), digits=DIGITS)


def _peaks(spark, sf):
    return FE.peak_features(D.daily_segment_hour(_sparse(spark, sf), FEAT["min_daily"]))


_FEAT_CTES = O.features_ctes("sparse", **FEAT)


@query("peak_velocity", f"""
WITH {_FEAT_CTES}
SELECT osm_id, {rnd('am')} AS am_velocity, {rnd('pm')} AS pm_velocity
FROM peaks WHERE COALESCE(am, pm) IS NOT NULL""")
def q_peak_velocity(spark, sf):
    p = _peaks(spark, sf)
    return round_doubles(p.where(F.col("am_velocity").isNotNull() | F.col("pm_velocity").isNotNull())
                         .select("osm_id", "am_velocity", "pm_velocity"))


@query("nonpeak_baseline", f"""
WITH {_FEAT_CTES}
SELECT osm_id, {rnd('off_am')} AS non_am_baseline_velocity, {rnd('off_pm')} AS non_pm_baseline_velocity
FROM peaks WHERE COALESCE(off_am, off_pm) IS NOT NULL""")
def q_nonpeak_baseline(spark, sf):
    p = _peaks(spark, sf)
    return round_doubles(p.where(F.col("non_am_baseline_velocity").isNotNull()
                                 | F.col("non_pm_baseline_velocity").isNotNull())
                         .select("osm_id", "non_am_baseline_velocity", "non_pm_baseline_velocity"))


@query("slowdown_frequency", f"""
WITH {_FEAT_CTES}
SELECT osm_id, {rnd('often_am')} AS am_slowdown_frequency, {rnd('often_pm')} AS pm_slowdown_frequency
FROM peaks WHERE COALESCE(often_am, often_pm) IS NOT NULL""")
def q_slowdown_frequency(spark, sf):
    p = _peaks(spark, sf)
    return round_doubles(p.where(F.col("am_slowdown_frequency").isNotNull()
                                 | F.col("pm_slowdown_frequency").isNotNull())
                         .select("osm_id", "am_slowdown_frequency", "pm_slowdown_frequency"))


@query("segment_features", f"WITH {_FEAT_CTES} SELECT * FROM segment_features")
def q_segment_features(spark, sf):
    return _features(spark, sf, **FEAT)


@query("complete_cohort", f"WITH {_FEAT_CTES}, {O.complete_cte()} SELECT * FROM complete_segments")
def q_complete_cohort(spark, sf):
    return FE.complete_cohort(_features(spark, sf, **FEAT))


@query("cohort_comparison", f"""
WITH {_FEAT_CTES}, {O.complete_cte()},
t AS (SELECT CASE WHEN osm_id IN (SELECT osm_id FROM complete_segments) THEN 'complete' ELSE 'excluded' END
             AS cohort, CAST(observation_count AS DOUBLE) AS oc, CAST(active_days AS DOUBLE) AS ad
      FROM segment_features)
SELECT cohort, COUNT(*) AS segments, {rnd('AVG(oc)')} AS mean_observations, {rnd('median(oc)')} AS median_observations,
       {rnd('AVG(ad)')} AS mean_active_days, {rnd('median(ad)')} AS median_active_days
FROM t GROUP BY cohort""")
def q_cohort_comparison(spark, sf):
    return FE.cohort_comparison(_features(spark, sf, **FEAT), digits=DIGITS)


# -------------------------------- scaling (H1, G36, G43) ------------------
_CLUS_CTES = f"{O.features_ctes('sparse', **CLUS)}, {O.complete_cte()}, {O.scaled_cte()}"
_SCALED = [f"{c}_scaled" for c in C.FEATURES]


def _scaled(spark, sf):
    return C.scale(FE.complete_cohort(_features(spark, sf, **CLUS)))


@query("scaled_features", f"""
WITH {_CLUS_CTES}
SELECT osm_id, {', '.join(f"{rnd(c)} AS {c}" for c in _SCALED)} FROM scaled""")
def q_scaled_features(spark, sf):
    return round_doubles(_scaled(spark, sf).select("osm_id", *_SCALED))


@query("scaling_check", f"""
WITH {_CLUS_CTES},
long AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c}_scaled AS v FROM scaled" for c in C.FEATURES)})
SELECT feature, {rnd('AVG(v)')} AS mean, {rnd('STDDEV_SAMP(v)')} AS std FROM long GROUP BY feature""")
def q_scaling_check(spark, sf):
    return C.scaling_check(_scaled(spark, sf), digits=DIGITS)


@query("feature_volume_corr", f"""
WITH {_CLUS_CTES}
{' UNION ALL '.join(f"SELECT '{c}' AS feature, {rnd(f'corr({c}, CAST(observation_count AS DOUBLE))')} AS corr_with_observation_count FROM complete_segments" for c in C.FEATURES)}""")
def q_feature_volume_corr(spark, sf):
    return C.feature_volume_corr(FE.complete_cohort(_features(spark, sf, **CLUS)), digits=DIGITS)


# -------------------------------- cluster statistics, fixed assignment -----
_FIXED = f"{_CLUS_CTES}, {O.fixed_clusters_ctes()}"


def _fixed_clusters(spark, sf):
    def build():
        a = C.with_group_centroid_distance(X.fixed_assignment(_scaled(spark, sf), 5))
        labels = C.label_clusters(C.cluster_means(a))
        return a.join(F.broadcast(labels), "cluster_id")  # k rows
    return materialize(build(), "fixed-clusters")


@query("cluster_labels", f"WITH {_FIXED} SELECT cluster_id, cluster_label FROM labels")
def q_cluster_labels(spark, sf):
    a = X.fixed_assignment(_scaled(spark, sf), 5)
    return C.label_clusters(C.cluster_means(a))


@query("cluster_sizes", f"""
WITH {_FIXED}, g AS (SELECT cluster_id, COUNT(*) AS segment_count FROM clusters GROUP BY cluster_id)
SELECT cluster_id, segment_count, {rnd('segment_count * 100.0 / (SELECT SUM(segment_count) FROM g)')} AS pct_of_cohort
FROM g""")
def q_cluster_sizes(spark, sf):
    return C.cluster_sizes(_fixed_clusters(spark, sf), digits=DIGITS)


@query("cluster_profile", f"""
WITH {_FIXED}
SELECT cluster_id, COUNT(*) AS count, {rnd('AVG(median_velocity)')} AS median_vel_mean,
       {rnd('STDDEV_SAMP(median_velocity)')} AS median_vel_std, {rnd('AVG(am_relative_slowdown)')} AS am_slowdown_mean,
       {rnd('median(am_relative_slowdown)')} AS am_slowdown_median, {rnd('AVG(am_slowdown_frequency)')} AS am_freq_mean,
       {rnd('AVG(pm_relative_slowdown)')} AS pm_slowdown_mean, {rnd('median(pm_relative_slowdown)')} AS pm_slowdown_median,
       {rnd('AVG(pm_slowdown_frequency)')} AS pm_freq_mean, {rnd('AVG(velocity_std)')} AS vel_std_mean,
       {rnd('AVG(observation_count)')} AS avg_obs_count, {rnd('AVG(active_days)')} AS avg_active_days
FROM clusters GROUP BY cluster_id""")
def q_cluster_profile(spark, sf):
    return C.cluster_profile(_fixed_clusters(spark, sf), digits=DIGITS)


@query("cluster_describe", f"WITH {_FIXED}, {_describe_sql('clusters', C.FEATURES, by='cluster_id')}")
def q_cluster_describe(spark, sf):
    return Q.numeric_summary(_fixed_clusters(spark, sf), C.FEATURES, by=["cluster_id"], digits=DIGITS)


@query("cluster_boxplot", f"""
WITH {_FIXED},
long AS ({' UNION ALL '.join(f"SELECT cluster_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM clusters WHERE {c} IS NOT NULL" for c in C.FEATURES)}),
q AS (SELECT cluster_id, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
             quantile_cont(value, 0.75) AS q3 FROM long GROUP BY ALL),
j AS (SELECT l.*, q.q1, q.med, q.q3, q.q1 - 1.5 * (q.q3 - q.q1) AS lo, q.q3 + 1.5 * (q.q3 - q.q1) AS hi
      FROM long l JOIN q ON l.cluster_id = q.cluster_id AND l.feature = q.feature)
SELECT cluster_id, feature, {rnd('ANY_VALUE(q1)')} AS q1, {rnd('ANY_VALUE(med)')} AS median, {rnd('ANY_VALUE(q3)')} AS q3,
       {rnd('ANY_VALUE(q3) - ANY_VALUE(q1)')} AS iqr, {rnd('MIN(value) FILTER (WHERE value >= lo)')} AS whisker_low,
       {rnd('MAX(value) FILTER (WHERE value <= hi)')} AS whisker_high,
       COUNT(*) FILTER (WHERE value < lo OR value > hi) AS outliers
FROM j GROUP BY cluster_id, feature""")
def q_cluster_boxplot(spark, sf):
    return C.cluster_boxplot(_fixed_clusters(spark, sf), digits=DIGITS)


@query("nearest_to_centroid", f"""
WITH {_FIXED},
r AS (SELECT cluster_id, osm_id, dist_to_centroid,
             CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY dist_to_centroid, osm_id) AS INTEGER) AS rank
      FROM clusters)
SELECT cluster_id, osm_id, {rnd('dist_to_centroid')} AS dist_to_centroid, rank FROM r WHERE rank <= 3""")
def q_nearest_to_centroid(spark, sf):
    n = C.nearest_to_centroid(_fixed_clusters(spark, sf), n=3)
    return n.select("cluster_id", "osm_id", rounded("dist_to_centroid", DIGITS).alias("dist_to_centroid"), "rank")


@query("silhouette_sq_euclidean", f"""
WITH {_FIXED},
pair AS (SELECT a.osm_id, a.cluster_id AS ca, b.cluster_id AS cb,
                {' + '.join(f'POWER(a.{c} - b.{c}, 2)' for c in _SCALED)} AS d2
         FROM clusters a JOIN clusters b ON a.osm_id <> b.osm_id),
per AS (SELECT osm_id, ca, cb, AVG(d2) AS md FROM pair GROUP BY ALL),
s AS (SELECT osm_id, MAX(CASE WHEN ca = cb THEN md END) AS a, MIN(CASE WHEN ca <> cb THEN md END) AS b
      FROM per GROUP BY osm_id)
SELECT {rnd('AVG(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / GREATEST(a, b) END)')} AS silhouette FROM s""")
def q_silhouette(spark, sf):
    return round_doubles(C.silhouette_sq_euclidean(_fixed_clusters(spark, sf)))


# -------------------------------- insights (C7-C9, G39, G40) --------------
_SEV = f"""sev AS (
    SELECT *, CASE WHEN am_relative_slowdown < 0 THEN 0.0 ELSE am_relative_slowdown END * am_slowdown_frequency
                  AS am_expected_slowdown,
              CASE WHEN pm_relative_slowdown < 0 THEN 0.0 ELSE pm_relative_slowdown END * pm_slowdown_frequency
                  AS pm_expected_slowdown
    FROM clusters),
sev2 AS (
    SELECT *, GREATEST(am_expected_slowdown, pm_expected_slowdown) AS candidate_severity,
           CASE WHEN am_expected_slowdown >= pm_expected_slowdown THEN 'AM' ELSE 'PM' END AS primary_peak,
           CASE WHEN active_days < 100 THEN 'Lower' ELSE 'Standard' END AS confidence
    FROM sev)"""


@query("candidate_severity", f"""
WITH {_FIXED}, {_SEV}
SELECT osm_id, cluster_label, primary_peak, {rnd('candidate_severity')} AS candidate_severity, confidence,
       {rnd('am_relative_slowdown')} AS am_relative_slowdown, {rnd('am_slowdown_frequency')} AS am_slowdown_frequency,
       {rnd('pm_relative_slowdown')} AS pm_relative_slowdown, {rnd('pm_slowdown_frequency')} AS pm_slowdown_frequency,
       observation_count, active_days
FROM sev2 ORDER BY sev2.candidate_severity DESC NULLS LAST, osm_id LIMIT 20""")
def q_candidate_severity(spark, sf):
    return IN.candidate_severity(_fixed_clusters(spark, sf), n=20, digits=DIGITS)


@query("cluster_hour_profile", f"""
WITH {_FIXED},
dsh AS (SELECT d.osm_id, d.hour, d.daily_average_velocity, c.cluster_label
        FROM daily_segment_hour d JOIN clusters c ON d.osm_id = c.osm_id),
seg_hourly AS (SELECT osm_id, cluster_label, hour, AVG(daily_average_velocity) AS v FROM dsh GROUP BY ALL),
seg_base AS (SELECT osm_id, AVG(daily_average_velocity) AS baseline_velocity FROM dsh GROUP BY osm_id)
SELECT cluster_label, hour, {rnd('AVG(b.baseline_velocity - h.v)')} AS relative_slowdown
FROM seg_hourly h JOIN seg_base b ON h.osm_id = b.osm_id GROUP BY cluster_label, hour ORDER BY 1, 2""")
def q_cluster_hour_profile(spark, sf):
    daily = D.daily_segment_hour(_sparse(spark, sf), CLUS["min_daily"])
    return IN.cluster_hour_profile(daily, _fixed_clusters(spark, sf), digits=DIGITS)


@query("segment_map", f"""
WITH {_FIXED}, {_SEV},
coords AS (SELECT osm_id, AVG(longitude) AS lon, AVG(latitude) AS lat FROM observations GROUP BY osm_id),
top AS (SELECT osm_id FROM sev2 ORDER BY candidate_severity DESC NULLS LAST, osm_id LIMIT 20)
SELECT s.osm_id, s.cluster_id, s.cluster_label, {rnd('c.lon')} AS lon, {rnd('c.lat')} AS lat,
       {rnd('s.candidate_severity')} AS candidate_severity, s.osm_id IN (SELECT osm_id FROM top) AS is_top_candidate
FROM sev2 s JOIN coords c ON s.osm_id = c.osm_id""")
def q_segment_map(spark, sf):
    return IN.segment_map(_sparse(spark, sf), _fixed_clusters(spark, sf), n=20, digits=DIGITS)


# -------------------------------- hash-seeded fits (H2, H3, C6, C12) ------
#: Iterations that a fit of the registered queries may take, and that the oracle writes out.
FIT_STEPS = 25
_SWEEP = ClusterParams().sweep_k


@query("kmeans_clusters", f"""
WITH {_CLUS_CTES}, {O.fitted_ctes((5,), 20, 42, FIT_STEPS)}, {O.label_ctes()}
SELECT a.osm_id, a.cluster_id, l.cluster_label, {rnd('SQRT(a.d2)')} AS dist_to_centroid,
       {', '.join('a.' + c for c in C.CLUSTER_COLUMNS[4:])}
FROM assigned a JOIN labels l ON a.cluster_id = l.cluster_id""")
def q_kmeans_clusters(spark, sf):
    params = ClusterParams(k=5, restarts=20, seed=42, max_iter=FIT_STEPS)
    return C.segment_clusters(_features(spark, sf, **CLUS), params, digits=DIGITS)[0]


@query("k_sweep", f"""
WITH {_CLUS_CTES}, {O.fitted_ctes(_SWEEP, 10, 42, FIT_STEPS)},
pairs AS (
  SELECT x.k, x.osm_id, x.cluster_id AS ca, y.cluster_id AS cb, AVG({' + '.join(f'POWER(x.{c} - y.{c}, 2)' for c in _SCALED)}) AS md
  FROM assigned x JOIN assigned y ON x.k = y.k AND x.osm_id <> y.osm_id GROUP BY ALL),
sides AS (SELECT k, osm_id, MAX(md) FILTER (ca = cb) AS a, MIN(md) FILTER (ca <> cb) AS b FROM pairs GROUP BY k, osm_id)
SELECT k, {rnd('ANY_VALUE(cost)')} AS inertia,
       {rnd('AVG(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / GREATEST(a, b) END)')} AS silhouette_score
FROM sides JOIN chosen USING (k) GROUP BY k""")
def q_k_sweep(spark, sf):
    return C.k_sweep(_features(spark, sf, **CLUS), ClusterParams(sweep_restarts=10, max_iter=FIT_STEPS), digits=DIGITS)


# -------------------------------- fits from fixed centres (H2, H3, C6, C12) --
LLOYD_STEPS = 5


def _start(scaled, k):
    """Group means of segment id mod k (k rows) as the centres to start from."""
    rows = C.group_centroids(X.fixed_assignment(scaled, k)).orderBy("cluster_id").collect()
    return [[r[c] for c in _SCALED] for r in rows]


@query("kmeans_fixed_start", f"""
WITH {_CLUS_CTES}, {O.lloyd_ctes(5, LLOYD_STEPS)}, {O.label_ctes()}
SELECT a.osm_id, a.cluster_id, l.cluster_label, {rnd('SQRT(a.d2)')} AS dist_to_centroid,
       {', '.join('a.' + c for c in C.CLUSTER_COLUMNS[4:])}
FROM assigned a JOIN labels l ON a.cluster_id = l.cluster_id""")
def q_kmeans_fixed_start(spark, sf):
    features = _features(spark, sf, **CLUS)
    start = _start(C.scale(FE.complete_cohort(features)), 5)
    return C.segment_clusters(features, ClusterParams(max_iter=LLOYD_STEPS, tol=0.0), digits=DIGITS, initial=start)[0]


def _sweep_sql(k):
    return f"""SELECT {k} AS k, (SELECT {rnd('SUM(d2)')} FROM k{k}assigned) AS inertia,
       {rnd('AVG(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / GREATEST(a, b) END)')} AS silhouette_score
FROM (SELECT osm_id, MAX(md) FILTER (ca = cb) AS a, MIN(md) FILTER (ca <> cb) AS b FROM (
        SELECT x.osm_id, x.cluster_id AS ca, y.cluster_id AS cb, AVG({' + '.join(f'POWER(x.{c} - y.{c}, 2)' for c in _SCALED)}) AS md
        FROM k{k}assigned x JOIN k{k}assigned y ON x.osm_id <> y.osm_id GROUP BY ALL) GROUP BY osm_id)"""


@query("k_sweep_fixed_start", f"""
WITH {_CLUS_CTES}, {', '.join(O.lloyd_ctes(k, LLOYD_STEPS, p=f'k{k}') for k in (2, 3, 5))}
{' UNION ALL '.join(map(_sweep_sql, (2, 3, 5)))}""")
def q_k_sweep_fixed_start(spark, sf):
    features = _features(spark, sf, **CLUS)
    scaled = C.scale(FE.complete_cohort(features))
    return C.k_sweep(features, ClusterParams(max_iter=LLOYD_STEPS, tol=0.0), digits=DIGITS,
                     initial={k: _start(scaled, k) for k in (2, 3, 5)})


# -------------------------------- sub-aggregates shown on their own -------
@query("segment_hour_profile", f"""
WITH {OBS_D}
SELECT osm_id, hour, COUNT(*) AS observation_count, {rnd('AVG(velocity)')} AS hourly_velocity
FROM observations GROUP BY osm_id, hour HAVING COUNT(*) >= 15""")
def q_segment_hour_profile(spark, sf):
    return round_doubles(S.segment_hour_profile(_dense(spark, sf), min_obs=15))


@query("recurring_summary", f"""
WITH {OBS_D}, {O.daily_cte(2)}
SELECT osm_id, hour, COUNT(*) AS observed_days, CAST(SUM(daily_observation_count) AS BIGINT) AS total_observations,
       {rnd('AVG(daily_average_velocity)')} AS average_daily_velocity,
       {rnd('MIN(daily_average_velocity)')} AS minimum_daily_velocity,
       {rnd('MAX(daily_average_velocity)')} AS maximum_daily_velocity,
       {rnd('VAR_POP(daily_average_velocity)')} AS daily_velocity_variance
FROM daily_segment_hour GROUP BY osm_id, hour HAVING COUNT(*) >= 5""")
def q_recurring_summary(spark, sf):
    return round_doubles(S.recurring_summary(D.daily_segment_hour(_dense(spark, sf), 2), min_days=5))


@query("segment_centres", f"""
WITH {OBS_S}
SELECT osm_id, {rnd('AVG(longitude)')} AS lon, {rnd('AVG(latitude)')} AS lat FROM observations GROUP BY osm_id""")
def q_segment_centres(spark, sf):
    return round_doubles(IN.segment_centres(_sparse(spark, sf)))


@query("coverage_describe", f"WITH {_COV_SQL}, {_describe_sql('cov', ['observation_count', 'active_days'])}")
def q_coverage_describe(spark, sf):
    return Q.numeric_summary(FE.segment_coverage(_sparse(spark, sf)), ["observation_count", "active_days"],
                             digits=DIGITS)


@query("largest_date_gaps", f"""
WITH {CLEANC}, {_DATES}, {_GAPS}
SELECT CAST(date AS VARCHAR) AS date, CAST(previous_date AS VARCHAR) AS previous_date,
       CAST(date - previous_date AS BIGINT) AS gap_days
FROM gaps WHERE previous_date IS NOT NULL ORDER BY gap_days DESC, date LIMIT 10""")
def q_largest_date_gaps(spark, sf):
    return present(Q.largest_date_gaps(_clean(spark, sf), n=10))


# -------------------------------- roll-ups as separate profiles (G30, G25) -
_HOURLY = """hourly AS (SELECT CAST(timestamp AS DATE) AS date, hour, day_of_week, COUNT(velocity) AS observation_count,
                  SUM(velocity) AS velocity_sum FROM observations GROUP BY ALL)"""


@query("hour_rollup", f"""
WITH {OBS_D}, {_HOURLY}
SELECT hour, CAST(SUM(observation_count) AS BIGINT) AS observation_count, {rnd('SUM(velocity_sum)')} AS velocity_sum,
       {rnd('SUM(velocity_sum) / SUM(observation_count)')} AS velocity_mean
FROM hourly GROUP BY hour ORDER BY hour""")
def q_hour_rollup(spark, sf):
    return round_doubles(P.rollup_by(P.hourly_date_stats(_dense(spark, sf)), "hour"))


@query("date_rollup", f"""
WITH {OBS_D}, {_HOURLY}
SELECT CAST(date AS VARCHAR) AS date, CAST(SUM(observation_count) AS BIGINT) AS observation_count,
       {rnd('SUM(velocity_sum)')} AS velocity_sum, {rnd('SUM(velocity_sum) / SUM(observation_count)')} AS velocity_mean
FROM hourly GROUP BY date ORDER BY date""")
def q_date_rollup(spark, sf):
    return present(round_doubles(P.rollup_by(P.hourly_date_stats(_dense(spark, sf)), "date")))


@query("daily_mean_velocity_describe", f"""
WITH {OBS_D}, {_HOURLY},
dp AS (SELECT date, SUM(velocity_sum) / SUM(observation_count) AS velocity_mean FROM hourly GROUP BY date),
{_describe_sql('dp', ['velocity_mean'])}""")
def q_daily_mean_velocity_describe(spark, sf):
    dp = P.rollup_by(P.hourly_date_stats(_dense(spark, sf)), "date")
    return Q.numeric_summary(dp, ["velocity_mean"], digits=DIGITS)


# ==========================================================================
# The file path (A1-A11): tables written, read back and compared
# ==========================================================================
import uuid  # noqa: E402

from roadpulse.operators import feasibility as FZ  # noqa: E402
from roadpulse.plans import sql as SQL  # noqa: E402
from roadpulse.plans import stages as ST  # noqa: E402
from roadpulse.session import ensure_checkpoint_dir  # noqa: E402
from roadpulse.sources import load as L  # noqa: E402
from roadpulse.sources import tables as TB  # noqa: E402


def _folder(spark, name: str) -> str:
    """A new folder in the shared space."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex[:12]}"


def _raw_file(spark, sf) -> str:
    """The raw rows as a text file with quoted coordinates, missing-value tokens, and short and long lines."""
    path = _folder(spark, "raw-csv")
    X.raw_lines(spark, sf).write.text(path)
    return path


@query("raw_file_round_trip", f"""
WITH {O.RAW_FILE_CTE}
SELECT "Date", "Time", "Coordinate (Lon, Lat)", "Course", "Velocity", "OSM ID" FROM file_rows WHERE kind <> 'long'""")
def q_raw_file_round_trip(spark, sf):
    return RAW.read_checked(spark, _raw_file(spark, sf))[0]


@query("raw_file_lines", f"""
WITH {O.RAW_FILE_CTE}
SELECT COUNT(*) AS lines, COUNT(*) FILTER (WHERE kind <> 'long') AS rows_read, COUNT(*) FILTER (WHERE kind = 'long') AS rejected,
       COUNT(*) FILTER (WHERE kind = 'long') AS more_fields, CAST(MAX(CASE WHEN kind = 'long' THEN 8 END) AS INTEGER) AS widest_rejected,
       COUNT(*) FILTER (WHERE kind = 'whole') AS rows_read_strictly
FROM file_rows""")
def q_raw_file_lines(spark, sf):
    path = _raw_file(spark, sf)
    rows, rejected = RAW.read_checked(spark, path)
    strict = RAW.read_checked(spark, path, short_lines="reject")[0]
    # every file begins with the header
    lines = spark.read.text(path).where(~F.col("value").startswith("Date,")).agg(F.count(F.lit(1)).alias("lines"))
    bad = rejected.agg(F.count(F.lit(1)).alias("rejected"), F.count_if(F.col("reason").startswith("more")).alias("more_fields"),
                       F.max("n_fields").alias("widest_rejected"))
    n = rows.agg(F.count(F.col("`OSM ID`").isNull()).alias("n")).scalar()
    n_strict = strict.agg(F.count(F.col("`OSM ID`").isNull()).alias("n")).scalar()
    return lines.join(F.broadcast(bad)).select("lines", n.alias("rows_read"), "rejected", "more_fields", "widest_rejected", n_strict.alias("rows_read_strictly"))


@query("raw_file_preview", f"""
WITH {O.RAW_FILE_CTE}
SELECT "Date", "Time", "Coordinate (Lon, Lat)", "Course", "Velocity", "OSM ID" FROM file_rows WHERE kind = 'whole' ORDER BY event_id LIMIT 100""")
def q_raw_file_preview(spark, sf):
    path = _folder(spark, "raw-csv")
    X.raw_lines(spark, sf, ordered=True).write.text(path)
    return RAW.preview_files(spark, path, 100)


_COUNTS = {
    "total_rows": "COUNT(*)", "invalid_timestamp_rows": "COUNT(*) FILTER (WHERE _ts IS NULL)",
    "invalid_coordinate_rows": "COUNT(*) FILTER (WHERE _lon IS NULL OR _lat IS NULL OR abs(_lon) > 180 OR abs(_lat) > 90)",
    "unparsed_coordinate_rows": "COUNT(*) FILTER (WHERE _lon IS NULL OR _lat IS NULL)",
    "zero_coordinate_rows": "COUNT(*) FILTER (WHERE _lon = 0 OR _lat = 0)",
    "out_of_range_coordinate_rows": "COUNT(*) FILTER (WHERE abs(_lon) > 180 OR abs(_lat) > 90)",
    "min_timestamp": "epoch(MIN(_ts))", "max_timestamp": "epoch(MAX(_ts))", "velocity_count": "COUNT(_velocity)",
    "velocity_mean": "AVG(_velocity)", "velocity_std": "STDDEV_POP(_velocity)", "velocity_min": "MIN(_velocity)", "velocity_max": "MAX(_velocity)",
    "zero_exact": "COUNT(*) FILTER (WHERE _velocity = 0)", "near_zero": "COUNT(*) FILTER (WHERE _velocity < 0.1)",
    "below_slow": "COUNT(*) FILTER (WHERE _velocity < 1.0)",
} | {f"missing {c}": f'COUNT(*) FILTER (WHERE "{c}" IS NULL)' for c in _RAW_COLS}


@query("feasibility_report", f"""
WITH {RAWC}
{' UNION ALL '.join(f"SELECT '{k}' AS metric, {rnd(f'CAST({v} AS DOUBLE)')} AS value FROM parsed" for k, v in _COUNTS.items())}
UNION ALL SELECT 'clean rows written', CAST(COUNT(*) AS DOUBLE) FROM parsed
UNION ALL SELECT 'date partitions', CAST(COUNT(DISTINCT coalesce(CAST(CAST(_ts AS DATE) AS VARCHAR), 'none')) AS DOUBLE) FROM parsed""")
def q_feasibility_report(spark, sf):
    """All counts of the report, observed while the clean table is written."""
    path = _folder(spark, "traffic-clean")
    counts = FZ.write_observed(_raw(spark, sf), path)
    back = spark.read.parquet(path)
    more = back.agg(F.lit("clean rows written").alias("metric"), F.count(F.lit(1)).cast("double").alias("value")).unionByName(
        back.select("date").distinct().agg(F.lit("date partitions").alias("metric"), F.count(F.lit(1)).cast("double").alias("value")))
    return FZ.as_table(spark, counts).select("metric", rounded("value", DIGITS).alias("value")).unionByName(more)


@query("clean_csv_round_trip", f"""
WITH {CLEANC}
SELECT timestamp, CAST(date AS VARCHAR) AS date, year, month, day_of_week, hour, longitude, latitude, course, velocity, osm_id FROM clean""")
def q_clean_csv_round_trip(spark, sf):
    """The clean table as CSV with one header line per file, read back with its schema (A5)."""
    path = _folder(spark, "clean-csv")
    TB.write_table(_clean(spark, sf), path, fmt="csv")
    return present(TB.load_table(spark, path, fmt="csv", schema=RAW.CLEAN_SCHEMA))


@query("header_names", "SELECT unnest(range(0, 6)) AS place, unnest(['" + "', '".join(_RAW_COLS) + "']) AS name FROM (SELECT 1 FROM events LIMIT 1)")
def q_header_names(spark, sf):
    """Names of a header with runs of white space, normalised (A3)."""
    odd = _raw(spark, sf).toDF(" Date", "Time  ", "Coordinate   (Lon,  Lat)", "Course", "Velocity ", "OSM \t ID")
    names = RAW.normalize_columns(odd)
    return names.limit(1).select(F.posexplode(F.array(*[F.lit(c) for c in names.columns])).alias("place", "name")).select(
        F.col("place").cast("long").alias("place"), "name")


@query("loaded_twice", f"""
WITH {OBS_D}
SELECT CASE WHEN event_id % 3 = 0 THEN 'a' ELSE 'b' END AS load, CAST(date AS VARCHAR) AS date, COUNT(*) AS row_count, {rnd('SUM(velocity)')} AS velocity_sum
FROM observations GROUP BY ALL""")
def q_loaded_twice(spark, sf):
    """Two loads that share dates, one of them run twice."""
    obs, table = _dense(spark, sf), _folder(spark, "traffic-observations")
    for name, rows in (("a", obs.where("event_id % 3 = 0")), ("b", obs.where("event_id % 3 <> 0")), ("a", obs.where("event_id % 3 = 0"))):
        L.load(rows.drop("event_id"), table, name)
    back = L.loaded(spark, table).groupBy("load", "date").agg(F.count(F.lit(1)).alias("row_count"), F.sum("velocity").alias("velocity_sum"))
    return present(round_doubles(back))


_CHANGED = "date_diff('day', (SELECT MIN(CAST(ts AS DATE)) FROM events), date)"


@query("daily_summary_refreshed", f"""
WITH {OBS_D},
days AS (SELECT *, {_CHANGED} AS day FROM observations),
changed AS (
  SELECT osm_id, timestamp, hour, CASE WHEN day = 3 THEN velocity + 7 ELSE velocity END AS velocity FROM days WHERE day NOT IN (5, 9)
  UNION ALL SELECT osm_id, timestamp + INTERVAL 400 DAY, hour, velocity FROM days WHERE day = 4),
{O.daily_cte(2, source='changed')}
SELECT osm_id, CAST(observation_date AS VARCHAR) AS observation_date, hour, daily_observation_count,
       {R('daily_average_velocity')} AS daily_average_velocity
FROM daily_segment_hour""")
def q_daily_summary_refreshed(spark, sf):
    """A summary built with one date missing; then one date changes, one is removed, one comes new; only those are refreshed."""
    first = X.events(spark, sf).agg(F.min(F.to_date("ts"))).scalar()
    days = _dense(spark, sf).withColumn("day", F.datediff("date", first))
    summary = _folder(spark, "daily-summary")
    L.rebuild_daily(days.where("day <> 9"), summary)
    later = F.expr("INTERVAL 400 DAY")
    changed = days.where("day NOT IN (5, 9)").withColumn("velocity", F.when(F.col("day") == 3, F.col("velocity") + 7).otherwise(F.col("velocity")))
    new = days.where("day = 4").withColumn("date", F.date_add("date", 400)).withColumn("timestamp", F.col("timestamp") + later)
    touched = days.where("day IN (3, 5)").select("date").unionByName(new.select("date"))
    L.refresh_daily(changed.unionByName(new), summary, touched)
    return present(round_doubles(L.daily_summary(spark, summary, 2)))


@query("feature_files", f"WITH {_FEAT_CTES} SELECT * FROM segment_features")
def q_feature_files(spark, sf):
    """The feature table written as CSV and read with its schema."""
    features, path = _features(spark, sf, **FEAT), _folder(spark, "segment-features")
    TB.write_table(features, path, fmt="csv")
    return TB.load_table(spark, path, fmt="csv", schema=features.schema)


@query("cluster_files", f"""
WITH {_FIXED}
SELECT osm_id, cluster_id, cluster_label, {rnd('dist_to_centroid')} AS dist_to_centroid, {', '.join(C.CLUSTER_COLUMNS[4:])} FROM clusters""")
def q_cluster_files(spark, sf):
    """The cluster table written as Parquet and read back."""
    rows = _fixed_clusters(spark, sf).withColumn("dist_to_centroid", rounded("dist_to_centroid", DIGITS)).select(*C.CLUSTER_COLUMNS)
    path = _folder(spark, "segment-clusters")
    TB.write_table(rows, path)
    return TB.load_table(spark, path)


@query("half_even_rounding", f"""
WITH {OBS_D}
SELECT event_id, CAST(CASE WHEN (event_id * 25) % 100 = 50 AND ((event_id * 25) // 100) % 2 = 0 THEN (event_id * 25) // 100
                           ELSE floor((event_id * 25) / 100.0 + 0.5) END AS DOUBLE) AS half_even,
       CAST(floor((event_id * 25) / 100.0 + 0.5) AS DOUBLE) AS half_up
FROM observations""")
def q_half_even_rounding(spark, sf):
    """Quarters rounded to whole numbers, half to even beside half up."""
    from roadpulse.functions.columns import rounded_half_even
    quarters = _dense(spark, sf).select("event_id", (F.col("event_id") * 25 / F.lit(100.0)).alias("q"))
    return quarters.select("event_id", rounded_half_even("q", 0).alias("half_even"), F.floor(F.col("q") + 0.5).cast("double").alias("half_up"))


@query("feature_null_audit", f"""
WITH {_FEAT_CTES}, t AS (SELECT COUNT(*) AS n FROM segment_features),
m AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_count FROM segment_features" for c in FE.FEATURE_COLUMNS)})
SELECT column_name, missing_count, {rnd('missing_count * 100.0 / n')} AS pct_missing FROM m, t""")
def q_feature_null_audit(spark, sf):
    """Missing values of the feature table."""
    return Q.null_audit(_features(spark, sf, **FEAT), digits=DIGITS)


@query("cohort_null_audit", f"""
WITH {_FEAT_CTES}, {O.complete_cte()}, t AS (SELECT COUNT(*) AS n FROM complete_segments),
m AS ({' UNION ALL '.join(f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing_count FROM complete_segments" for c in FE.FEATURE_COLUMNS)})
SELECT column_name, missing_count, {rnd('missing_count * 100.0 / n')} AS pct_missing FROM m, t""")
def q_cohort_null_audit(spark, sf):
    """Missing values of the clustering input: none are left."""
    return Q.null_audit(FE.complete_cohort(_features(spark, sf, **FEAT)), digits=DIGITS)


# -------------------------------- SQL text with parameters (A8) -----------
def _views(spark, obs, daily):
    ST.register_views(obs, daily)


@query("sql_relative_slowdowns", ORACLE["relative_slowdowns"])
def q_sql_relative_slowdowns(spark, sf):
    obs = _dense(spark, sf)
    _views(spark, obs, D.daily_segment_hour(obs, 2))
    return SQL.run_named(spark, "relative_slowdowns", min_obs=15, n=50, digits=DIGITS)


@query("sql_recurring_slowdowns", ORACLE["recurring_slowdowns"])
def q_sql_recurring_slowdowns(spark, sf):
    obs = _dense(spark, sf)
    _views(spark, obs, D.daily_segment_hour(obs, 2))
    return SQL.run_named(spark, "recurring_slowdowns", min_days=5, n=50, digits=DIGITS)


@query("sql_weekday_weekend", ORACLE["weekday_weekend"])
def q_sql_weekday_weekend(spark, sf):
    obs = _dense(spark, sf)
    _views(spark, obs, D.daily_segment_hour(obs, 2))
    return SQL.run_named(spark, "weekday_weekend", min_days=2, n=30, digits=DIGITS)


@query("sql_candidate_bottlenecks", ORACLE["candidate_bottlenecks"])
def q_sql_candidate_bottlenecks(spark, sf):
    obs = _dense(spark, sf)
    _views(spark, obs, D.daily_segment_hour(obs, 1))
    return SQL.run_named(spark, "candidate_bottlenecks", min_days=5, min_obs=10, n=30, digits=DIGITS)


# ==========================================================================
# Inputs on which a report can go wrong: calendars with gaps, limits and
# thresholds that cut, missing means
# ==========================================================================
#: Days are moved apart: after every 5th day three are missing, after every 11th four more.
_DAY = "date_diff('day', (SELECT MIN(CAST(ts AS DATE)) FROM events), date)"
_GAPPY = f"""{OBS_D}, clean AS (
    SELECT CAST(date + CAST(3 * ({_DAY} // 5) + 4 * ({_DAY} // 11) AS INTEGER) AS DATE) AS date FROM observations), {_DATES}"""


def _gappy(spark, sf):
    first = X.events(spark, sf).agg(F.min(F.to_date("ts"))).scalar()
    day = F.datediff("date", first)
    moved = (3 * F.floor(day / 5) + 4 * F.floor(day / 11)).cast("int")
    return _dense(spark, sf).withColumn("date", F.date_add("date", moved))


@query("gappy_coverage_summary", f"""
WITH {_GAPPY}, {_GAPS},
b AS (SELECT MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) AS n FROM d),
g AS (SELECT MAX(date - previous_date) AS largest, COUNT(*) FILTER (WHERE date - previous_date > 1) AS longer
      FROM gaps WHERE previous_date IS NOT NULL)
SELECT CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date,
       CAST(last_date - first_date + 1 AS BIGINT) AS calendar_days_in_range, n AS dates_with_observations,
       CAST(last_date - first_date + 1 - n AS BIGINT) AS missing_calendar_dates,
       n / CAST(last_date - first_date + 1 AS DOUBLE) AS coverage_rate,
       CAST(COALESCE(largest, 0) AS BIGINT) AS largest_gap_between_observed_dates, longer AS gaps_longer_than_one_day
FROM b, g""")
def q_gappy_coverage_summary(spark, sf):
    return present(Q.coverage_summary(_gappy(spark, sf)))


@query("gappy_missing_dates", f"""
WITH {_GAPPY},
cal AS (SELECT CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d)
SELECT CAST(date AS VARCHAR) AS missing_date FROM cal WHERE date NOT IN (SELECT date FROM d)""")
def q_gappy_missing_dates(spark, sf):
    return present(Q.missing_dates(_gappy(spark, sf)))


@query("gappy_date_gaps", f"""
WITH {_GAPPY}, {_GAPS}
SELECT CAST(date AS VARCHAR) AS date, CAST(previous_date AS VARCHAR) AS previous_date, CAST(date - previous_date AS BIGINT) AS gap_days
FROM gaps WHERE previous_date IS NOT NULL""")
def q_gappy_date_gaps(spark, sf):
    return present(Q.date_gaps(_gappy(spark, sf)))


@query("gappy_largest_date_gaps", f"""
WITH {_GAPPY}, {_GAPS}
SELECT CAST(date AS VARCHAR) AS date, CAST(previous_date AS VARCHAR) AS previous_date, CAST(date - previous_date AS BIGINT) AS gap_days
FROM gaps WHERE previous_date IS NOT NULL ORDER BY gap_days DESC, date LIMIT 4""")
def q_gappy_largest_date_gaps(spark, sf):
    return present(Q.largest_date_gaps(_gappy(spark, sf), n=4))


_TOP_PROFILE = """
WITH {obs}
SELECT osm_id, COUNT(*) AS total_row_count, {avg} AS average_velocity, {mn} AS minimum_velocity, {mx} AS maximum_velocity
FROM observations GROUP BY osm_id {having}
ORDER BY {order}, osm_id LIMIT 5"""


@query("segment_profile_top5", _TOP_PROFILE.format(obs=OBS_S, avg=rnd("AVG(velocity)"), mn=rnd("MIN(velocity)"), mx=rnd("MAX(velocity)"),
                                                   having="", order="total_row_count DESC"))
def q_segment_profile_top5(spark, sf):
    return P.segment_profile(_sparse(spark, sf), n=5, digits=DIGITS)


@query("low_velocity_screen_top5", _TOP_PROFILE.format(obs=OBS_S, avg=rnd("AVG(velocity)"), mn=rnd("MIN(velocity)"), mx=rnd("MAX(velocity)"),
                                                       having="HAVING COUNT(*) >= 66", order="AVG(velocity) ASC"))
def q_low_velocity_screen_top5(spark, sf):
    """About half of the segments lack the support of 66 rows."""
    return P.low_velocity_screen(_sparse(spark, sf), min_obs=66, n=5, digits=DIGITS)


@query("sparse_top_segment_share", f"""
WITH {OBS_S}, c AS (SELECT osm_id, COUNT(*) AS c FROM observations GROUP BY osm_id),
top AS (SELECT c FROM c ORDER BY c DESC, osm_id LIMIT 20)
SELECT 20 AS top_n, CAST((SELECT SUM(c) FROM top) AS BIGINT) AS top_rows, CAST((SELECT SUM(c) FROM c) AS BIGINT) AS total_rows,
       {rnd('CAST((SELECT SUM(c) FROM top) AS DOUBLE) / (SELECT SUM(c) FROM c)')} AS share""")
def q_sparse_top_segment_share(spark, sf):
    return round_doubles(P.top_segment_share(_sparse(spark, sf), n=20))


#: Segments have 20 to 30 active days.
_CUT = 27


@query("severity_two_labels", f"""
WITH {_FIXED}, {_SEV.replace('active_days < 100', f'active_days < {_CUT}')}
SELECT osm_id, cluster_label, primary_peak, {rnd('candidate_severity')} AS candidate_severity, confidence,
       {rnd('am_relative_slowdown')} AS am_relative_slowdown, {rnd('am_slowdown_frequency')} AS am_slowdown_frequency,
       {rnd('pm_relative_slowdown')} AS pm_relative_slowdown, {rnd('pm_slowdown_frequency')} AS pm_slowdown_frequency,
       observation_count, active_days
FROM sev2 ORDER BY sev2.candidate_severity DESC NULLS LAST, osm_id LIMIT 60""")
def q_severity_two_labels(spark, sf):
    return IN.candidate_severity(_fixed_clusters(spark, sf), low_confidence_days=_CUT, n=60, digits=DIGITS)


#: Two of three velocities are missing, so that many daily means are.
_HOLES = "CASE WHEN event_id % 3 = 0 THEN velocity END"


def _holed(spark, sf):
    return _sparse(spark, sf).withColumn("velocity", F.when(F.col("event_id") % 3 == 0, F.col("velocity")))


@query("bottlenecks_missing_means", bottleneck_sql("sparse", 1, 2, 2).replace(
    O.obs_cte("sparse"), f"{O.obs_cte('sparse', name='full_observations')}, observations AS (SELECT * REPLACE ({_HOLES} AS velocity) FROM full_observations)"))
def q_bottlenecks_missing_means(spark, sf):
    return S.candidate_bottlenecks(D.daily_segment_hour(_holed(spark, sf), 1), min_days=2, min_obs=2, n=30, digits=DIGITS)


@query("cluster_hours_missing_means", f"""
WITH {_FIXED}, holed AS (SELECT * REPLACE ({_HOLES} AS velocity) FROM observations),
{O.daily_cte(CLUS['min_daily'], name='holed_daily', source='holed')},
dsh AS (SELECT d.osm_id, d.hour, d.daily_average_velocity, c.cluster_label FROM holed_daily d JOIN clusters c ON d.osm_id = c.osm_id),
seg_hourly AS (SELECT osm_id, cluster_label, hour, AVG(daily_average_velocity) AS v FROM dsh GROUP BY ALL),
seg_base AS (SELECT osm_id, AVG(daily_average_velocity) AS baseline_velocity FROM dsh GROUP BY osm_id)
SELECT cluster_label, hour, {rnd('AVG(b.baseline_velocity - h.v)')} AS relative_slowdown
FROM seg_hourly h JOIN seg_base b ON h.osm_id = b.osm_id GROUP BY cluster_label, hour""")
def q_cluster_hours_missing_means(spark, sf):
    daily = D.daily_segment_hour(_holed(spark, sf), CLUS["min_daily"])
    return IN.cluster_hour_profile(daily, _fixed_clusters(spark, sf), digits=DIGITS)
