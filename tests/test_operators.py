"""Operators on hand-made frames: NULL, tie, empty, single-row cases and invariants."""
import datetime as dt

import pytest

from roadpulse.params import ClusterParams
from pyspark.sql import functions as F

from roadpulse.operators import cluster as C
from roadpulse.operators import daily as D
from roadpulse.operators import features as FE
from roadpulse.operators import insights as IN
from roadpulse.operators import profiles as P
from roadpulse.operators import quality as Q
from roadpulse.operators import slowdown as S
from roadpulse.sources import fixtures as X

OBS_SCHEMA = "timestamp timestamp_ntz, hour int, velocity double, osm_id string, longitude double, latitude double"


def obs(spark, rows):
    return spark.createDataFrame(rows, OBS_SCHEMA)


def ts(d, h, m=0):
    return dt.datetime(2015, 3, d, h, m)


def test_one_row_segment_sd_null_and_var_zero(spark):
    o = obs(spark, [(ts(20, 8), 8, 10.0, "way/1", 35.0, 33.0)])
    f = FE.moving_velocity_stats(o).first()
    assert f["median_velocity"] == 10.0 and f["velocity_std"] is None
    d = D.daily_segment_hour(o, 1)
    r = S.candidate_bottlenecks(d, min_days=1, min_obs=1).collect()
    assert r == []  # equal to its own baseline: not slower


def test_tie_at_limit_lower_osm_id_first(spark):
    rows = [(ts(20, 8), 8, 5.0, "way/b", 0.0, 0.0), (ts(20, 9), 9, 5.0, "way/a", 0.0, 0.0)]
    top = P.segment_profile(obs(spark, rows), n=1).collect()
    assert top[0]["osm_id"] == "way/a"


def test_zero_baseline_dropped_without_error(spark):
    rows = [(ts(d, h), h, 0.0, "way/0", 0.0, 0.0) for d in (20, 21) for h in (7, 8)]
    d = D.daily_segment_hour(obs(spark, rows), 1)
    assert S.candidate_bottlenecks(d, min_days=1, min_obs=1).count() == 0


def test_segment_without_pm_rows_has_null_pm_columns(spark):
    rows = [(ts(d, h), h, 10.0 + h, "way/1", 0.0, 0.0) for d in range(20, 31) for h in (7, 8, 9, 12)]
    o = obs(spark, rows)
    f = FE.segment_features(o, D.daily_segment_hour(o, 1), min_obs=1, min_active_days=1).first()
    assert f["pm_velocity"] is None and f["pm_relative_slowdown"] is None and f["pm_slowdown_frequency"] is None
    assert f["am_velocity"] is not None and f["am_slowdown_frequency"] == 1.0
    assert FE.complete_cohort(FE.segment_features(o, D.daily_segment_hour(o, 1), min_obs=1,
                                                  min_active_days=1)).count() == 0


def test_severity_negative_and_null_peaks(spark):
    df = spark.createDataFrame(
        [("way/1", "x", -2.0, 1.0, 3.0, 0.5, 10, 50), ("way/2", "x", None, None, 2.0, 1.0, 10, 150)],
        "osm_id string, cluster_label string, am_relative_slowdown double, am_slowdown_frequency double, "
        "pm_relative_slowdown double, pm_slowdown_frequency double, observation_count long, active_days long")
    r = {x["osm_id"]: x for x in IN.with_severity(df).collect()}
    assert r["way/1"]["am_expected_slowdown"] == 0.0 and r["way/1"]["candidate_severity"] == 1.5
    assert r["way/1"]["primary_peak"] == "PM" and r["way/1"]["confidence"] == "Lower"
    assert r["way/2"]["candidate_severity"] == 2.0 and r["way/2"]["primary_peak"] == "PM"
    assert r["way/2"]["confidence"] == "Standard"


def test_constant_feature_scales_to_zero(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(5)], "a double, b double")
    s = C.scale(df, ["a", "b"]).collect()
    assert all(r["b_scaled"] == 0.0 for r in s)
    assert abs(sum(r["a_scaled"] for r in s)) < 1e-12


def test_empty_input_keeps_schema(spark):
    e = obs(spark, [])
    d = D.daily_segment_hour(e, 5)
    assert d.count() == 0 and "daily_average_velocity" in d.columns
    assert S.relative_slowdowns(e, 1).count() == 0
    assert P.hourly_profile(e).count() == 0


def test_pivot_equals_selfjoin(spark):
    o = X.observations(spark, "/root/testdata/sf0.01", "dense")
    d = D.daily_segment_hour(o, 2)
    a = S.weekday_weekend(d, 2, 30, 6).collect()
    b = S.weekday_weekend_selfjoin(d, 2, 30, 6).collect()
    assert a == b and len(a) == 30


def test_invariants_on_fixture(spark):
    o = X.observations(spark, "/root/testdata/sf0.01", "dense")
    total = o.count()
    assert P.hourly_date_stats(o).agg(F.sum("observation_count")).first()[0] == total
    d = D.daily_segment_hour(o, 2)
    assert d.where(F.col("daily_observation_count") < 2).count() == 0
    f = FE.peak_features(d)
    bad = f.where((F.col("am_slowdown_frequency") < 0) | (F.col("am_slowdown_frequency") > 1)).count()
    assert bad == 0
    feats = FE.segment_features(X.observations(spark, "/root/testdata/sf0.01", "sparse"),
                                D.daily_segment_hour(X.observations(spark, "/root/testdata/sf0.01", "sparse"), 2),
                                min_obs=60, min_active_days=25)
    assert FE.complete_cohort(feats).count() + FE.excluded_cohort(feats).count() == feats.count()


def test_missing_dates_found(spark):
    clean = X.observations(spark, "/root/testdata/sf0.01", "dense").where(
        ~F.col("date").isin(dt.date(2024, 1, 10), dt.date(2024, 1, 11)))
    got = [r[0] for r in Q.missing_dates(clean).collect()]
    assert got == [dt.date(2024, 1, 10), dt.date(2024, 1, 11)]
    cov = Q.coverage_summary(clean).first()
    assert cov["missing_calendar_dates"] == 2 and cov["largest_gap_between_observed_dates"] == 3
    assert cov["gaps_longer_than_one_day"] == 1


def test_silhouette_matches_bruteforce(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(40, 2)) + np.repeat([[0, 0], [4, 4]], 20, axis=0)
    lab = np.repeat([0, 1], 20)
    lab[0] = 2  # singleton cluster
    df = spark.createDataFrame([(float(x), float(y), int(c)) for (x, y), c in zip(pts, lab)],
                               "a_scaled double, b_scaled double, cluster_id int")
    got = C.silhouette_sq_euclidean(df, ["a", "b"]).first()[0]
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(pts)):
        own = (lab == lab[i]) & (np.arange(len(pts)) != i)
        if own.sum() == 0:
            s.append(0.0)
            continue
        a = d2[i, own].mean()
        b = min(d2[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(s), abs=1e-9)


def test_label_rule_names_each_cluster_once(spark):
    means = spark.createDataFrame(
        [(0, 72.7, 21.0, -1.7, -0.3, .3, .3), (1, 35.8, 10.0, 3.7, 2.5, .74, .67), (2, 35.7, 10.0, -7.3, 1.3, .11, .56),
         (3, 57.2, 10.0, -9.0, 12.2, .1, .84), (4, 38.2, 10.0, 9.0, -9.8, .85, .10)],
        "cluster_id int, median_velocity double, velocity_std double, am_relative_slowdown double, "
        "pm_relative_slowdown double, am_slowdown_frequency double, pm_slowdown_frequency double")
    got = {r[0]: r[1] for r in C.label_clusters(means).collect()}
    assert got == {0: "High-Speed Free-Flow Corridors", 1: "Dual-Peak Rush-Hour Sensitive",
                   2: "Steady Moderate-Speed Flow", 3: "Severe Evening-Peak Bottlenecks",
                   4: "Severe Morning-Peak Bottlenecks"}


def test_kmeans_recovers_separated_blobs(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [6, 6], [-6, 6]])
    pts = np.vstack([c + rng.normal(scale=0.3, size=(30, 2)) for c in centres])
    df = spark.createDataFrame([(f"way/{i}", float(x), float(y)) for i, (x, y) in enumerate(pts)],
                               "osm_id string, a_scaled double, b_scaled double")
    model, cost = C.kmeans(df, ["a", "b"], k=3, restarts=3, seed=1)
    got = sorted(tuple(round(v) for v in c) for c in model.clusterCenters())
    assert got == sorted(tuple(int(v) for v in c) for c in centres)
    labels = model.transform(df).groupBy("cluster_id").count().collect()
    assert sorted(r["count"] for r in labels) == [30, 30, 30]
    fixed, fixed_cost = C.lloyd(df, {0: centres.tolist()}, ["a", "b"])[0]
    assert fixed_cost == pytest.approx(cost, rel=1e-6)
    one = C.kmeans(df, ["a", "b"], k=3, restarts=1, seed=1)[1]
    assert cost <= one + 1e-9 and C.kmeans(df, ["a", "b"], k=4, restarts=5, seed=1)[1] < cost


def test_empty_cohort_gives_empty_clusters(spark):
    cols = "osm_id string, median_velocity double, velocity_std double, observation_count long, active_days long, " \
           "am_velocity double, pm_velocity double, am_relative_slowdown double, pm_relative_slowdown double, " \
           "am_slowdown_frequency double, pm_slowdown_frequency double, zero_velocity_observation_count long"
    none = spark.createDataFrame([], cols)
    clusters, model, cost = C.segment_clusters(none)
    assert clusters.count() == 0 and model.clusterCenters() == [] and cost == 0.0
    assert [tuple(r) for r in C.k_sweep(none, ClusterParams(sweep_k=(2,), sweep_restarts=1)).collect()] == [(2, 0.0, None)]


def test_approx_median_option_close_to_exact(spark):
    o = X.observations(spark, "/root/testdata/sf0.01", "dense")
    exact = {r["osm_id"]: r["median_velocity"] for r in FE.moving_velocity_stats(o).collect()}
    approx = {r["osm_id"]: r["median_velocity"] for r in
              FE.moving_velocity_stats(o, approx_accuracy=10000).collect()}
    assert exact.keys() == approx.keys()
    # approximate median is an actual value within a small rank distance of the exact one
    assert sum(abs(exact[k] - approx[k]) for k in exact) / len(exact) < 2.0


def test_bottleneck_sign_and_scaling_invariants(spark):
    o = X.observations(spark, "/root/testdata/sf0.01", "dense")
    top = S.candidate_bottlenecks(D.daily_segment_hour(o, 1), min_days=5, min_obs=10, n=1000, digits=None)
    rows = top.collect()
    assert rows and all(r["velocity_drop"] > 0 and 0 < r["slowdown_percentage"] <= 100 for r in rows)
    feats = FE.segment_features(X.observations(spark, "/root/testdata/sf0.01", "sparse"),
                                D.daily_segment_hour(X.observations(spark, "/root/testdata/sf0.01", "sparse"), 1),
                                min_obs=40, min_active_days=20)
    sc = C.scale(FE.complete_cohort(feats))
    stats = sc.agg(*[F.avg(f"{c}_scaled").alias(f"m_{c}") for c in C.FEATURES],
                   *[F.stddev_pop(f"{c}_scaled").alias(f"s_{c}") for c in C.FEATURES]).first()
    for c in C.FEATURES:
        assert abs(stats[f"m_{c}"]) < 1e-9 and abs(stats[f"s_{c}"] - 1.0) < 1e-9


def test_distinct_counts_exact_and_sketched(spark):
    raw = X.raw_text(spark, "/root/testdata/sf0.01")
    exact = {r[0]: r[1] for r in Q.raw_distinct_counts(raw).collect()}
    assert exact["OSM ID"] == 20 and exact["valid date"] == 30
    near = Q.distinct_estimates(Q.distinct_sketches(raw, ["Course"], ["Date", "Velocity", "OSM ID"]), [])
    for r in near.collect():  # merged over the groups
        assert abs(r["distinct_estimate"] - exact[r["column_name"]]) <= max(2, 0.07 * exact[r["column_name"]])


def test_equal_fingerprints_of_different_rows_are_told_apart(spark, monkeypatch):
    real = Q.F.xxhash64
    monkeypatch.setattr(Q.F, "xxhash64", lambda *c: real(Q.F.lit(7)))  # every row collides
    df = spark.createDataFrame([("a", None), ("a", None), (None, "a"), ("b", "c"), ("b", "c"), ("b", "c")], "x string, y string")
    assert tuple(Q.duplicate_report(df).first()) == (2, 3)


def test_threshold_grid_of_any_size(spark):
    cov = spark.range(500).selectExpr("id * 7 % 300 AS observation_count", "id % 41 AS active_days")
    rows = [tuple(r) for r in cov.collect()]
    got = FE.threshold_grid(cov, range(0, 300, 10), range(0, 45, 2), digits=None).collect()
    assert len(got) == 30 * 23
    for r in got:
        assert r["surviving_segments"] == sum(a >= r["min_observations"] and b >= r["min_active_days"] for a, b in rows)


def _plain_fits(rows, ks, restarts, seed, steps):
    """Inertia of the best fit of each k by plain loops; rows: (key, point)."""
    import hashlib
    import math

    def sq(x, c):
        return sum((a - b) ** 2 for a, b in zip(x, c))

    def nearest(x, centres):
        return min((sq(x, c), i) for i, c in enumerate(centres))

    def race(key, x, r, step, found):
        u = (int(hashlib.md5(f"{key}:{seed}:{r}:{step}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0 ** 52
        d2 = nearest(x, found)[0] if found else 1.0
        return -math.log(u) / d2 if d2 > 0 else math.inf

    best = {}
    for r in range(restarts):
        found = []
        for step in range(max(ks)):
            found.append(min((race(key, x, r, step, found), key, x) for key, x in rows)[2])
        for k in ks:
            centres = found[:k]
            for _ in range(steps):
                own = [nearest(x, centres)[1] for _, x in rows]
                moved = [[sum(v) / len(v) for v in zip(*[x for (_, x), o in zip(rows, own) if o == i])] or c for i, c in enumerate(centres)]
                shift, centres = sum(map(sq, moved, centres)), moved
                if shift <= 1e-4:
                    break
            best[k] = min(best.get(k, math.inf), sum(nearest(x, centres)[0] for _, x in rows))
    return best


def test_fits_of_a_small_cohort_use_all_cores_and_equal_plain_loops(spark, monkeypatch):
    import numpy as np
    pts = np.round(np.random.default_rng(3).normal(size=(120, 6)) + np.arange(120)[:, None] % 4 * 2, 2)
    pts[100:] = pts[:20]  # equal rows, so that some draws have distance 0
    cols = "osm_id string, " + ", ".join(f"{c} double" for c in C.FEATURES)
    feats = spark.createDataFrame([(f"way/{i}", *map(float, x)) for i, x in enumerate(pts)], cols).coalesce(1)
    written, passes, write, one = [], [], C.materialize, C._pass
    monkeypatch.setattr(C, "materialize", lambda df, name: written.append(write(df, name)) or written[-1])
    monkeypatch.setattr(C, "_pass", lambda *a: passes.append(one(*a)) or passes[-1])
    got = {r["k"]: r["inertia"] for r in C.k_sweep(feats, ClusterParams(sweep_k=(2, 5), sweep_restarts=3, max_iter=25), digits=None).collect()}
    # a table of a few KB, yet one part for each core
    assert written[0].rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    # what a pass shuffles is bounded by the centres: no row is multiplied by the models
    assert "Generate" not in passes[0]._jdf.queryExecution().executedPlan().toString()
    scaled = (pts - pts.mean(axis=0)) / pts.std(axis=0)
    want = _plain_fits([(f"way/{i}", [float(v) for v in x]) for i, x in enumerate(scaled)], (2, 5), 3, 42, 25)
    assert got == pytest.approx(want, rel=1e-9)


def test_nearest_centre_on_ties_and_nan(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (float("nan"), 1.0)], "a_scaled double, b_scaled double")
    rows = C._pass(df, {7: [[1.0, 0.0], [1.0, 0.0], [float("nan"), 0.0]], 9: [[float("nan"), 0.0], [3.0, 0.0]]}, ["a", "b"]).collect()
    got = {(r["m"], r["i"]): (r["n"], r["x1"]) for r in rows}
    # of equally near centres the first; NaN is farther than any distance
    assert got == {(7, 0): (3, 1.0), (9, 0): (1, 1.0), (9, 1): (2, 0.0)}
