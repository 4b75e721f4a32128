"""End-to-end: raw CSV file -> every stage table."""
import os
import tempfile

from roadpulse.params import ClusterParams, Thresholds
from roadpulse.plans import stages
from roadpulse.sources import fixtures as X


def test_run_all_end_to_end(spark):
    work = tempfile.mkdtemp(prefix="rp-e2e-")
    raw_path = os.path.join(work, "raw")
    X.raw_text(spark, "/root/testdata/sf0.001").coalesce(1).write.option("header", True).csv(raw_path)
    t = Thresholds(min_daily_obs=1, low_velocity_min_obs=10, segment_hour_min_obs=2, recurring_min_days=2,
                   day_type_min_days=1, bottleneck_min_days=2, bottleneck_min_obs=2, feature_min_obs=10,
                   feature_min_active_days=5)
    cp = ClusterParams(k=3, restarts=2, sweep_k=(2, 3), sweep_restarts=2)
    out = stages.run_all(spark, raw_path, os.path.join(work, "out"), t=t, cp=cp, bucket_daily=4, on_bad="drop")
    read = lambda name: (spark.table(out[name][6:]) if out[name].startswith("table:")
                         else spark.read.parquet(out[name]))
    # 1,010 raw rows (1,000 + 10 copies); 11 bad dates plus the copy of event 0 (bad and copied) are dropped
    assert read("traffic_clean").count() == 1010 - 12
    assert read("feasibility/validity_report").first()["total_rows"] == 1010
    assert read("feasibility/dropped_rows").first()["value"] == 12.0
    assert read("feasibility/rejected_lines").count() == 0
    assert any(d.startswith("date=") for d in os.listdir(out["traffic_clean"]))
    assert read("daily_segment_hour").count() > 0
    assert read("analysis/candidate_bottlenecks").count() > 0
    feats = read("segment_features")
    assert feats.count() > 0
    clusters = read("segment_clusters")
    assert clusters.count() == feats.na.drop("any").count()
    assert set(r[0] for r in clusters.select("cluster_id").distinct().collect()) <= {0, 1, 2}
    assert read("ml/k_sweep").count() == 2
    assert read("insights/candidate_severity").count() > 0
    assert read("insights/segment_map").count() == clusters.count()


def test_register_views_for_adhoc_sql(spark):
    from roadpulse.operators import daily as D
    obs = X.observations(spark, "/root/testdata/sf0.001", "dense")
    stages.register_views(obs, D.daily_segment_hour(obs, 1))
    n = spark.sql("SELECT COUNT(*) AS n FROM traffic_observations").first()["n"]
    assert n == 1000
    top = spark.sql("SELECT osm_id, hour, COUNT(*) AS d FROM daily_segment_hour GROUP BY osm_id, hour "
                    "ORDER BY d DESC, osm_id, hour LIMIT 1").collect()
    assert len(top) == 1
