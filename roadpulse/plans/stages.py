"""End-to-end stage compositions.

The analysed workload runs four stages and hands tables between them as files
(clean observations -> SQL table -> daily summary -> feature table -> cluster
table).  Here every hand-over is a Parquet table under the session's
checkpoint folder (``spark.checkpoint.dir`` on a cluster), which also cuts
lineage: a lost executor recomputes from the last written stage, never from
the raw scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadpulse.operators import cluster as C
from roadpulse.operators import daily as D
from roadpulse.operators import feasibility as FZ
from roadpulse.operators import features as FE
from roadpulse.operators import insights as IN
from roadpulse.operators import profiles as P
from roadpulse.operators import quality as Q
from roadpulse.operators import slowdown as S
from roadpulse.params import ClusterParams, PeakHours, Thresholds
from roadpulse.sources import raw as RAW
from roadpulse.sources.tables import write_table

def feasibility_report(raw: DataFrame, clean: DataFrame, counts: dict) -> dict[str, DataFrame]:
    """Stage 00 checks (C10).  Validity, missing values, moments and near-zero shares come from the ``counts`` observed
    while the clean table was written, all else from that table; only the search for equal rows reads the raw text."""
    return {
        **FZ.reports(raw.sparkSession, counts, raw.columns),
        "distinct_counts": Q.distinct_counts(clean.drop("year", "month", "day_of_week", "hour")),
        "date_counts": Q.date_counts(clean),
        "segment_counts": Q.segment_counts(clean),
        "duplicate_report": Q.duplicate_report(raw),
        "coverage_summary": Q.coverage_summary(clean),
        "missing_dates": Q.missing_dates(clean),
        "largest_date_gaps": Q.largest_date_gaps(clean),
        "timestamp_gaps": Q.timestamp_gaps(clean),
        "near_zero_by_hour": Q.near_zero_by_hour(clean),
        "near_zero_by_segment": Q.near_zero_by_segment(clean),
        "near_zero_segments": Q.near_zero_segments(clean),
        "hourly_date_stats": P.hourly_date_stats(clean),
        "segment_stats": P.segment_stats(clean),
    }


def analysis(obs: DataFrame, daily: DataFrame, t: Thresholds = Thresholds(), digits: int = 2) -> dict[str, DataFrame]:
    """Stage 01 SQL analyses over observations and the materialised daily summary."""
    return {
        "table_summary": P.table_summary(obs),
        "hourly_profile": P.hourly_profile(obs, digits),
        "segment_profile": P.segment_profile(obs, 20, digits),
        "low_velocity_screen": P.low_velocity_screen(obs, t.low_velocity_min_obs, 20, digits),
        "relative_slowdowns": S.relative_slowdowns(obs, t.segment_hour_min_obs, 50, digits),
        "recurring_slowdowns": S.recurring_slowdowns(daily, obs=obs, min_days=t.recurring_min_days, n=50,
                                                     digits=digits),
        "daily_summary_check": D.daily_summary_check(daily),
        "weekday_weekend": S.weekday_weekend(daily, t.day_type_min_days, 30, digits),
        "candidate_bottlenecks": S.candidate_bottlenecks(daily, t.bottleneck_min_days, t.bottleneck_min_obs, 30,
                                                         digits),
        "segment_coverage": FE.segment_coverage(obs),
    }


def run_all(spark: SparkSession, raw_path: str, out_dir: str, t: Thresholds = Thresholds(),
            peaks: PeakHours = PeakHours(), cp: ClusterParams = ClusterParams(),
            fmt: str = "parquet", bucket_daily: int | None = None, on_bad: str = "fail") -> dict[str, str]:
    """Raw file -> every result table, written under ``out_dir``.

    Rows without a usable timestamp raise (``on_bad='fail'``), are kept with NULL
    time parts ('null'), or are counted and dropped where that is asked for
    ('drop').  Returns {table name: path}.  Clean observations are written partitioned by
    date; the daily summary, feature table and cluster table are written once
    and re-read by the later stages.  With ``bucket_daily`` (a bucket count)
    the daily summary is saved as a catalog table bucketed by ``osm_id``, so
    the downstream aggregations by segment (and segment-hour) read it without
    a shuffle."""
    out = out_dir.rstrip("/")
    written: dict[str, str] = {}

    def put(name: str, df: DataFrame) -> DataFrame:
        path = f"{out}/{name}"
        write_table(df, path, fmt="parquet")
        written[name] = path
        return spark.read.parquet(path)

    raw, rejected = RAW.read_checked(spark, raw_path)
    written["traffic_clean"] = f"{out}/traffic_clean"
    # one pass over the raw text: the clean table, and the counts of all its rows (rows without a timestamp too)
    counts = FZ.write_observed(raw, written["traffic_clean"], on_bad)
    obs = spark.read.parquet(written["traffic_clean"])
    put("feasibility/rejected_lines", rejected)
    for name, df in feasibility_report(raw, obs, counts).items():
        put(f"feasibility/{name}", df)
    put("feasibility/dropped_rows", FZ.as_table(spark, {"rows_without_timestamp_dropped": counts["invalid_timestamp_rows"] if on_bad == "drop" else 0}))
    if bucket_daily:
        from roadpulse.sources.tables import save_bucketed
        daily = save_bucketed(D.daily_segment_hour(obs, t.min_daily_obs), "daily_segment_hour", key="osm_id",
                              buckets=bucket_daily)
        written["daily_segment_hour"] = "table:daily_segment_hour"
    else:
        daily = put("daily_segment_hour", D.daily_segment_hour(obs, t.min_daily_obs))
    for name, df in analysis(obs, daily, t).items():
        put(f"analysis/{name}", df)
    cov = FE.segment_coverage(obs)
    put("analysis/threshold_grid", FE.threshold_grid(cov))
    put("analysis/coverage_histogram", FE.coverage_histogram(cov))
    feats = put("segment_features", FE.segment_features(obs, daily, peaks.am, peaks.pm, t.moving_velocity,
                                                         t.feature_min_obs, t.feature_min_active_days))
    put("ml/cohort_comparison", FE.cohort_comparison(feats))
    put("ml/feature_volume_corr", C.feature_volume_corr(FE.complete_cohort(feats)))
    put("ml/k_sweep", C.k_sweep(feats, cp))
    clusters_df, _, _ = C.segment_clusters(feats, cp)
    clusters = put("segment_clusters", clusters_df)
    put("ml/cluster_sizes", C.cluster_sizes(clusters))
    put("ml/cluster_profile", C.cluster_profile(clusters))
    put("ml/cluster_boxplot", C.cluster_boxplot(clusters))
    put("ml/nearest_to_centroid", C.nearest_to_centroid(clusters))
    put("insights/candidate_severity", IN.candidate_severity(clusters, t.low_confidence_days))
    put("insights/cluster_hour_profile", IN.cluster_hour_profile(daily, clusters))
    put("insights/segment_map", IN.segment_map(obs, clusters, 20, t.low_confidence_days))
    if fmt == "csv":
        for name in ("segment_features", "segment_clusters"):
            write_table(spark.read.parquet(written[name]), f"{out}/csv/{name}", fmt="csv")
    return written


def register_views(obs: DataFrame, daily: DataFrame | None = None, features: DataFrame | None = None,
                   clusters: DataFrame | None = None) -> None:
    """Expose the stage tables to ``spark.sql`` under the names the analysis
    uses (``traffic_observations``, ``daily_segment_hour``, ``segment_features``,
    ``segment_clusters``) for ad-hoc SQL (A6, A8)."""
    from roadpulse.sources.tables import register
    register(obs, "traffic_observations")
    for df, name in ((daily, "daily_segment_hour"), (features, "segment_features"), (clusters, "segment_clusters")):
        if df is not None:
            register(df, name)
