"""The slowdown analyses as SQL text with named parameters.

``run_named(spark, name, ...)`` plans one of ``TEXTS`` over the tables
``traffic_observations`` and ``daily_segment_hour`` (catalog tables or the views
that ``stages.register_views`` makes); values go in as ``:name`` parameters, not
as pasted text.  Baselines are windows over the segment-hour aggregate, at most
24 rows of a segment, as in the DataFrame forms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Output rounding; float noise beyond 12 decimals is taken off first.
_R = "ROUND(ROUND({}, 12), :digits)".format

TEXTS = {
    "relative_slowdowns": f"""
WITH cells AS (
  SELECT osm_id, CAST(hour AS INT) AS hour, COUNT(*) AS observation_count, SUM(velocity) AS total, COUNT(velocity) AS present
  FROM traffic_observations GROUP BY osm_id, hour),
compared AS (
  SELECT osm_id, hour, observation_count, try_divide(total, present) AS here,
    try_divide(SUM(total) OVER (PARTITION BY osm_id), SUM(present) OVER (PARTITION BY osm_id)) AS usual FROM cells)
SELECT osm_id, hour, observation_count, {_R('here')} AS hourly_velocity, {_R('usual')} AS baseline_velocity, {_R('here - usual')} AS velocity_difference
FROM compared WHERE observation_count >= :min_obs ORDER BY here - usual, osm_id, hour LIMIT :n""",
    "recurring_slowdowns": f"""
WITH usual AS (SELECT osm_id, AVG(velocity) AS usual FROM traffic_observations GROUP BY osm_id),
cells AS (
  SELECT osm_id, hour, COUNT(*) AS observed_days, SUM(daily_observation_count) AS total_observations, AVG(daily_average_velocity) AS here,
    MAX(daily_average_velocity) AS highest, VAR_POP(daily_average_velocity) AS spread
  FROM daily_segment_hour GROUP BY osm_id, hour HAVING COUNT(*) >= :min_days)
SELECT osm_id, hour, observed_days, total_observations, {_R('here')} AS average_daily_velocity, {_R('usual')} AS baseline_velocity,
  {_R('here - usual')} AS velocity_difference, {_R('highest')} AS maximum_daily_velocity,
  {_R(f"SQRT(GREATEST({_R('spread')}, 0D))")} AS daily_velocity_std
FROM cells JOIN usual USING (osm_id) ORDER BY velocity_difference, osm_id, hour LIMIT :n""",
    "weekday_weekend": f"""
WITH sides AS (
  SELECT osm_id, hour, COUNT_IF(WEEKDAY(observation_date) < 5) AS weekday_days, COUNT_IF(WEEKDAY(observation_date) >= 5) AS weekend_days,
    AVG(daily_average_velocity) FILTER (WHERE WEEKDAY(observation_date) < 5) AS on_weekdays,
    AVG(daily_average_velocity) FILTER (WHERE WEEKDAY(observation_date) >= 5) AS on_weekends
  FROM daily_segment_hour GROUP BY osm_id, hour)
SELECT osm_id, hour, weekday_days, weekend_days, {_R('on_weekdays')} AS weekday_velocity, {_R('on_weekends')} AS weekend_velocity,
  {_R('on_weekdays - on_weekends')} AS weekday_minus_weekend
FROM sides WHERE LEAST(weekday_days, weekend_days) >= :min_days ORDER BY on_weekdays - on_weekends, osm_id, hour LIMIT :n""",
    "candidate_bottlenecks": f"""
WITH cells AS (
  SELECT osm_id, hour, COUNT(*) AS observed_days, SUM(daily_observation_count) AS total_observations, SUM(daily_average_velocity) AS total,
    COUNT(daily_average_velocity) AS present, AVG(daily_average_velocity) AS here, VAR_POP(daily_average_velocity) AS spread
  FROM daily_segment_hour GROUP BY osm_id, hour),
compared AS (
  SELECT *, try_divide(SUM(total) OVER (PARTITION BY osm_id), SUM(present) OVER (PARTITION BY osm_id)) AS usual FROM cells)
SELECT osm_id, hour, observed_days, total_observations, {_R('here')} AS average_daily_velocity, {_R('usual')} AS baseline_velocity,
  {_R('usual - here')} AS velocity_drop, {_R('100.0D * (usual - here) / usual')} AS slowdown_percentage,
  {_R(f"SQRT(GREATEST({_R('spread')}, 0D))")} AS daily_velocity_std
FROM compared WHERE observed_days >= :min_days AND total_observations >= :min_obs AND usual > 0 AND here < usual
ORDER BY slowdown_percentage DESC, observed_days DESC, osm_id, hour LIMIT :n""",
}


def run_named(spark: SparkSession, name: str, **params) -> DataFrame:
    """One of ``TEXTS`` with its parameters (each needs ``digits`` and ``n``, and its thresholds)."""
    if name not in TEXTS:
        raise KeyError(f"no analysis named {name!r}; there are {', '.join(TEXTS)}")
    return spark.sql(TEXTS[name], args=params)
