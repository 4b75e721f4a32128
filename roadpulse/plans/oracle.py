"""Independent DuckDB formulations of the registered queries.

Each string runs on DuckDB with the supplied tables registered as views.  They
follow the analysed SQL directly (separate aggregations, joins, self-joins),
not the Spark plans, so agreement is a real cross-check.  Fixture adapters are
the same definitions as ``roadpulse.sources.fixtures``.
"""

from __future__ import annotations

from roadpulse.params import (
    AM_HOURS,
    LABEL_DUAL_PEAK,
    LABEL_EVENING,
    LABEL_FREE_FLOW,
    LABEL_MORNING,
    LABEL_STEADY,
    PM_HOURS,
)


def _hours(h) -> str:
    return ", ".join(str(x) for x in h)


AM, PM = _hours(AM_HOURS), _hours(PM_HOURS)

SEG = {"dense": "user_id % 20", "sparse": "user_id"}


def obs_cte(segment: str = "dense", name: str = "observations") -> str:
    return f"""{name} AS (
    SELECT event_id,
           CAST(date_trunc('second', ts) AS TIMESTAMP) AS timestamp,
           CAST(ts AS DATE) AS date,
           CAST(year(ts) AS INTEGER) AS year,
           CAST(month(ts) AS INTEGER) AS month,
           CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
           CAST(hour(ts) AS INTEGER) AS hour,
           CAST(35.1 + (user_id % 20) * 0.05 + (event_id % 10) * 0.001 AS DOUBLE) AS longitude,
           CAST(33.1 + (user_id % 20) * 0.05 + (event_id % 7) * 0.001 AS DOUBLE) AS latitude,
           CAST((event_id * 37) % 360 AS DOUBLE) AS course,
           CAST(value AS DOUBLE) AS velocity,
           'way/' || CAST({SEG[segment]} AS VARCHAR) AS osm_id
    FROM events)"""


def daily_cte(min_daily: int, name: str = "daily_segment_hour", source: str = "observations") -> str:
    return f"""{name} AS (
    SELECT osm_id, CAST(timestamp AS DATE) AS observation_date, hour,
           COUNT(*) AS daily_observation_count,
           AVG(velocity) AS daily_average_velocity
    FROM {source}
    GROUP BY osm_id, CAST(timestamp AS DATE), hour
    HAVING COUNT(*) >= {min_daily})"""


RAW_CTE = """raw_rows AS (
    SELECT CASE WHEN event_id % 97 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d') END AS "Date",
           strftime(ts, '%H:%M:%S') AS "Time",
           CASE WHEN event_id % 89 = 0 THEN 'n/a'
                WHEN event_id % 83 = 0 THEN '999.0, 33.0'
                ELSE CAST(351 + user_id % 20 AS VARCHAR) || 'e-1, ' || CAST(331 + user_id % 20 AS VARCHAR) || 'e-1'
           END AS "Coordinate (Lon, Lat)",
           CAST((event_id * 37) % 360 AS VARCHAR) AS "Course",
           CASE WHEN event_id % 79 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS "Velocity",
           'way/' || CAST(user_id % 20 AS VARCHAR) AS "OSM ID",
           event_id
    FROM events),
raw AS (
    SELECT "Date", "Time", "Coordinate (Lon, Lat)", "Course", "Velocity", "OSM ID" FROM raw_rows
    UNION ALL
    SELECT "Date", "Time", "Coordinate (Lon, Lat)", "Course", "Velocity", "OSM ID" FROM raw_rows
    WHERE event_id % 101 = 0),
parsed AS (
    SELECT *,
           try_strptime("Date" || ' ' || "Time", '%Y-%m-%d %H:%M:%S') AS _ts,
           TRY_CAST(trim(regexp_extract("Coordinate (Lon, Lat)", '^\\s*([^,]+),\\s*([^,]+)\\s*$', 1)) AS DOUBLE) AS _lon,
           TRY_CAST(trim(regexp_extract("Coordinate (Lon, Lat)", '^\\s*([^,]+),\\s*([^,]+)\\s*$', 2)) AS DOUBLE) AS _lat,
           TRY_CAST("Course" AS DOUBLE) AS _course,
           TRY_CAST("Velocity" AS DOUBLE) AS _velocity
    FROM raw)"""


RAW_FILE_CTE = """file_rows AS (
    SELECT event_id, CASE WHEN event_id % 61 = 0 THEN 'short' WHEN event_id % 67 = 0 THEN 'long' ELSE 'whole' END AS kind,
           strftime(ts, '%Y-%m-%d') AS "Date", strftime(ts, '%H:%M:%S') AS "Time",
           CAST(351 + user_id % 20 AS VARCHAR) || 'e-1, ' || CAST(331 + user_id % 20 AS VARCHAR) || 'e-1' AS "Coordinate (Lon, Lat)",
           CASE WHEN event_id % 59 = 0 THEN NULL ELSE CAST((event_id * 37) % 360 AS VARCHAR) END AS "Course",
           CASE WHEN event_id % 61 = 0 OR event_id % 53 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END AS "Velocity",
           CASE WHEN event_id % 61 = 0 THEN NULL ELSE 'way/' || CAST(user_id % 20 AS VARCHAR) END AS "OSM ID"
    FROM events)"""


def rnd(expr: str, digits: int = 6) -> str:
    """DuckDB side of ``functions.rounded``: float noise beyond 12 decimals off, then HALF_UP in decimal."""
    return f"CAST(ROUND(CAST(ROUND({expr}, 12) AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


CLEAN_CTE = """clean AS (
    SELECT _ts AS timestamp, CAST(_ts AS DATE) AS date,
           CAST(year(_ts) AS INTEGER) AS year, CAST(month(_ts) AS INTEGER) AS month,
           CAST(isodow(_ts) - 1 AS INTEGER) AS day_of_week, CAST(hour(_ts) AS INTEGER) AS hour,
           _lon AS longitude, _lat AS latitude, _course AS course, _velocity AS velocity,
           CAST("OSM ID" AS VARCHAR) AS osm_id
    FROM parsed)"""


def features_ctes(segment: str, min_daily: int, min_obs: int, min_days: int, digits: int = 6,
                  name: str = "segment_features") -> str:
    """The feature table: one grouped pass over the observations and one over the
    daily rows, which carry their segment's off-peak means as window values."""
    R = lambda e: rnd(e, digits)
    return f"""{obs_cte(segment)}, {daily_cte(min_daily)},
seen AS (
    SELECT osm_id, COUNT(*) AS observation_count, COUNT(DISTINCT CAST(timestamp AS DATE)) AS active_days,
           COUNT(*) FILTER (velocity < 0.1) AS zero_velocity_observation_count,
           {R('median(velocity) FILTER (velocity >= 0.1)')} AS median_velocity,
           {R('stddev_samp(velocity) FILTER (velocity >= 0.1)')} AS velocity_std
    FROM observations GROUP BY osm_id HAVING observation_count >= {min_obs} AND active_days >= {min_days}),
marked AS (
    SELECT osm_id, daily_average_velocity AS v, hour IN ({AM}) AS am, hour IN ({PM}) AS pm,
           AVG(daily_average_velocity) FILTER (hour NOT IN ({AM})) OVER whole AS off_am,
           AVG(daily_average_velocity) FILTER (hour NOT IN ({PM})) OVER whole AS off_pm,
           COUNT(*) FILTER (hour NOT IN ({AM})) OVER whole > 0 AS has_off_am,
           COUNT(*) FILTER (hour NOT IN ({PM})) OVER whole > 0 AS has_off_pm
    FROM daily_segment_hour WINDOW whole AS (PARTITION BY osm_id)),
peaks AS (
    SELECT osm_id, AVG(v) FILTER (am) AS am, AVG(v) FILTER (pm) AS pm, ANY_VALUE(off_am) AS off_am, ANY_VALUE(off_pm) AS off_pm,
           AVG(CASE WHEN v < off_am THEN 1.0 ELSE 0.0 END) FILTER (am AND has_off_am) AS often_am,
           AVG(CASE WHEN v < off_pm THEN 1.0 ELSE 0.0 END) FILTER (pm AND has_off_pm) AS often_pm
    FROM marked GROUP BY osm_id),
{name} AS (
    SELECT osm_id, median_velocity, velocity_std, observation_count, active_days,
           {R('am')} AS am_velocity, {R('pm')} AS pm_velocity,
           {R('off_am - am')} AS am_relative_slowdown, {R('off_pm - pm')} AS pm_relative_slowdown,
           {R('often_am')} AS am_slowdown_frequency, {R('often_pm')} AS pm_slowdown_frequency,
           zero_velocity_observation_count
    FROM seen LEFT JOIN peaks USING (osm_id))"""


FEATS = ("median_velocity", "velocity_std", "am_relative_slowdown", "pm_relative_slowdown",
         "am_slowdown_frequency", "pm_slowdown_frequency")


def complete_cte(source: str = "segment_features", name: str = "complete_segments") -> str:
    cond = " AND ".join(f"{c} IS NOT NULL" for c in
                        ("osm_id", "median_velocity", "velocity_std", "observation_count", "active_days",
                         "am_velocity", "pm_velocity") + FEATS + ("zero_velocity_observation_count",))
    return f"{name} AS (SELECT * FROM {source} WHERE {cond})"


def scaled_cte(source: str = "complete_segments", name: str = "scaled") -> str:
    cols = ", ".join(f"({c} - AVG({c}) OVER ()) / COALESCE(NULLIF(STDDEV_POP({c}) OVER (), 0), 1) AS {c}_scaled"
                     for c in FEATS)
    return f"{name} AS (SELECT *, {cols} FROM {source})"




def label_ctes() -> str:
    """Labels by the rule on unscaled means of ``assigned`` (sequential elimination)."""
    means = ", ".join(f"AVG({c}) AS {c}" for c in FEATS)
    return f"""cmeans AS (SELECT cluster_id, {means} FROM assigned GROUP BY cluster_id),
l1 AS (SELECT cluster_id FROM cmeans ORDER BY am_relative_slowdown DESC, cluster_id LIMIT 1),
l2 AS (SELECT cluster_id FROM cmeans WHERE cluster_id NOT IN (SELECT cluster_id FROM l1)
       ORDER BY pm_relative_slowdown DESC, cluster_id LIMIT 1),
l3 AS (SELECT cluster_id FROM cmeans WHERE cluster_id NOT IN (SELECT cluster_id FROM l1 UNION ALL SELECT cluster_id FROM l2)
       ORDER BY median_velocity DESC, cluster_id LIMIT 1),
l4 AS (SELECT cluster_id FROM cmeans
       WHERE cluster_id NOT IN (SELECT cluster_id FROM l1 UNION ALL SELECT cluster_id FROM l2 UNION ALL SELECT cluster_id FROM l3)
       ORDER BY am_relative_slowdown + pm_relative_slowdown DESC, cluster_id LIMIT 1),
labels AS (
    SELECT cluster_id,
           CASE WHEN cluster_id IN (SELECT cluster_id FROM l1) THEN '{LABEL_MORNING}'
                WHEN cluster_id IN (SELECT cluster_id FROM l2) THEN '{LABEL_EVENING}'
                WHEN cluster_id IN (SELECT cluster_id FROM l3) THEN '{LABEL_FREE_FLOW}'
                WHEN cluster_id IN (SELECT cluster_id FROM l4) THEN '{LABEL_DUAL_PEAK}'
                ELSE '{LABEL_STEADY}' END AS cluster_label
    FROM cmeans)"""


def fixed_clusters_ctes(k: int = 5, source: str = "scaled", name: str = "clusters") -> str:
    """Fixed assignment (numeric segment id mod k), labels by the rule on
    unscaled means (sequential elimination), distance to the group mean."""
    dist = " + ".join(f"POWER(s.{c}_scaled - m.{c}_c, 2)" for c in FEATS)
    cents = ", ".join(f"AVG({c}_scaled) AS {c}_c" for c in FEATS)
    return f"""assigned AS (
    SELECT *, CAST(CAST(regexp_extract(osm_id, '(\\d+)$', 1) AS BIGINT) % {k} AS INTEGER) AS cluster_id
    FROM {source}),
centres AS (SELECT cluster_id, {cents} FROM assigned GROUP BY cluster_id),
{label_ctes()},
{name} AS (
    SELECT s.*, l.cluster_label, SQRT({dist}) AS dist_to_centroid
    FROM assigned s JOIN centres m ON s.cluster_id = m.cluster_id JOIN labels l ON s.cluster_id = l.cluster_id)"""


def lloyd_ctes(k: int, steps: int, source: str = "scaled", p: str = "") -> str:
    """``steps`` Lloyd steps from the group means of segment id mod k; the
    nearest of the last centres is ``{p}assigned`` (with ``d2``)."""
    d2 = " + ".join(f"POWER(s.{c}_scaled - m.{c}_c, 2)" for c in FEATS)
    first = ", ".join(f"AVG({c}_scaled) AS {c}_c" for c in FEATS)
    moved = ", ".join(f"COALESCE(AVG(s.{c}_scaled), ANY_VALUE(o.{c}_c)) AS {c}_c" for c in FEATS)
    near = (f"SELECT s.osm_id, CAST(arg_min(m.cluster_id, {d2}) AS INTEGER) AS cluster_id, MIN({d2}) AS d2 "
            f"FROM {source} s CROSS JOIN {{}} m GROUP BY s.osm_id")
    out = [f"{p}c0 AS MATERIALIZED (SELECT CAST(regexp_extract(osm_id, '(\\d+)$', 1) AS BIGINT) % {k} AS cluster_id, {first} FROM {source} GROUP BY 1)"]
    for i in range(steps):
        out.append(f"{p}a{i} AS MATERIALIZED ({near.format(f'{p}c{i}')})")
        out.append(f"{p}c{i + 1} AS MATERIALIZED (SELECT o.cluster_id, {moved} FROM {p}c{i} o LEFT JOIN {p}a{i} a "
                   f"ON a.cluster_id = o.cluster_id LEFT JOIN {source} s ON s.osm_id = a.osm_id GROUP BY o.cluster_id)")
    out.append(f"{p}assigned AS MATERIALIZED (SELECT s.*, n.cluster_id, n.d2 FROM {source} s JOIN ({near.format(f'{p}c{steps}')}) n ON s.osm_id = n.osm_id)")
    return ",\n".join(out)


def fitted_ctes(ks: tuple[int, ...], restarts: int, seed: int, steps: int, tol: float = 1e-4, source: str = "scaled") -> str:
    """D-squared seeding by hash races, then up to ``steps`` Lloyd steps of every (k, restart): ``best`` has the centres of
    each k's best restart with their place in coordinate order, ``assigned`` each row's nearest of them (with ``d2``)."""
    d2 = " + ".join(f"POWER(s.{c}_scaled - m.{c}_c, 2)" for c in FEATS)
    picked = ", ".join(f"s.{c}_scaled AS {c}_c" for c in FEATS)
    own = ", ".join(f"{c}_c" for c in FEATS)
    moved = ", ".join(f"CASE WHEN o.done THEN o.{c}_c ELSE COALESCE(AVG(s.{c}_scaled), o.{c}_c) END AS {c}_c" for c in FEATS)
    shift = " + ".join(f"POWER(n.{c}_c - o.{c}_c, 2)" for c in FEATS)

    def race(step: int) -> str:
        u = f"(CAST(('0x' || substr(md5(osm_id || ':{seed}:' || r || ':{step}'), 1, 13)) AS BIGINT) + 0.5) / {float(1 << 52)}"
        return f"-ln({u}) / d2"

    def pick(step: int, near: str) -> str:
        return (f"SELECT r, {step} AS j, {picked} FROM (SELECT * FROM ({near}) WHERE d2 > 0 QUALIFY row_number() OVER "
                f"(PARTITION BY r ORDER BY {race(step)}, osm_id) = 1) w JOIN {source} s ON s.osm_id = w.osm_id")

    out = [f"runs AS (SELECT CAST(unnest(range({restarts})) AS BIGINT) AS r)",
           f"seeds0 AS MATERIALIZED ({pick(0, f'SELECT osm_id, r, 1.0 AS d2 FROM {source}, runs')})"]
    for i in range(1, max(ks)):
        near = f"SELECT s.osm_id, m.r, MIN({d2}) AS d2 FROM {source} s, seeds{i - 1} m GROUP BY s.osm_id, m.r"
        out.append(f"seeds{i} AS MATERIALIZED (SELECT * FROM seeds{i - 1} UNION ALL {pick(i, near)})")
    every = ", ".join(f"({k})" for k in ks)
    out.append(f"at0 AS MATERIALIZED (SELECT k, r, j, {own}, FALSE AS done FROM seeds{max(ks) - 1}, (VALUES {every}) AS t(k) WHERE j < k)")
    near = f"SELECT s.osm_id, m.k, m.r, arg_min(m.j, {d2}) AS j, MIN({d2}) AS d2 FROM {source} s, {{}} m GROUP BY s.osm_id, m.k, m.r"
    for i in range(steps):
        out.append(f"near{i} AS MATERIALIZED ({near.format(f'at{i}')})")
        out.append(f"to{i} AS MATERIALIZED (SELECT o.k, o.r, o.j, o.done, {moved} FROM at{i} o LEFT JOIN near{i} a ON (a.k, a.r, a.j) = (o.k, o.r, o.j) "
                   f"LEFT JOIN {source} s ON s.osm_id = a.osm_id GROUP BY o.k, o.r, o.j, o.done, {', '.join(f'o.{c}_c' for c in FEATS)})")
        out.append(f"at{i + 1} AS MATERIALIZED (SELECT n.k, n.r, n.j, {', '.join(f'n.{c}_c' for c in FEATS)}, "
                   f"n.done OR SUM({shift}) OVER (PARTITION BY n.k, n.r) <= {tol} AS done FROM to{i} n JOIN at{i} o USING (k, r, j))")
    out.append(f"costs AS (SELECT k, r, SUM(d2) AS cost FROM ({near.format(f'at{steps}')}) GROUP BY k, r)")
    out.append("chosen AS (SELECT k, r, cost FROM costs QUALIFY row_number() OVER (PARTITION BY k ORDER BY ROUND(cost, 9), r) = 1)")
    out.append(f"best AS MATERIALIZED (SELECT a.k, CAST(row_number() OVER (PARTITION BY a.k ORDER BY {own}) - 1 AS INTEGER) AS cluster_id, {own} "
               f"FROM at{steps} a JOIN chosen c ON a.k = c.k AND a.r = c.r)")
    out.append(f"assigned AS MATERIALIZED (SELECT s.*, n.k, n.cluster_id, n.d2 FROM {source} s JOIN (SELECT s.osm_id, m.k, arg_min(m.cluster_id, {d2}) AS cluster_id, "
               f"MIN({d2}) AS d2 FROM {source} s, best m GROUP BY s.osm_id, m.k) n ON s.osm_id = n.osm_id)")
    return ",\n".join(out)
