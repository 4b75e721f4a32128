import sys
sys.path.insert(0, "/root/repo")
from roadpulse.session import local_session
from roadpulse.plans import registry as RG
from roadpulse.operators import cluster as C, features as FE, quantile as QT
from roadpulse.sources import fixtures as X
from pyspark.sql import functions as F

spark = local_session(8)
sf = "/root/testdata/sf0.1"

def tree(df):
    return df._jdf.queryExecution().executedPlan().toString()

def sketch_plan():
    obs = X.observations(spark, sf, "sparse").select("osm_id", "velocity")
    return obs.groupBy("osm_id").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("velocity", F.lit(QT.SKETCH_K)).alias("sketch"))

sections = [
    ("C1 relative_slowdowns: one pruned scan, partial aggregation, baseline as a window (no join)",
     RG.QUERIES["relative_slowdowns"](spark, sf)),
    ("C4 candidate_bottlenecks: daily summary and segment-hour profile from one scan",
     RG.QUERIES["candidate_bottlenecks"](spark, sf)),
    ("G16-G18 peak features: one window + aggregate sharing the osm_id partitioning",
     FE.peak_features(RG.D.daily_segment_hour(X.observations(spark, sf, "sparse"), 2))),
    ("F1 moving-velocity filter pushed into the Parquet scan",
     X.observations(spark, sf, "sparse").where("velocity >= 0.1").groupBy("osm_id").agg(F.stddev_samp("velocity"))),
    ("W3 nearest_to_centroid: top-n per cluster limited map-side before the shuffle",
     C.nearest_to_centroid(spark.range(1000).selectExpr("cast(id % 5 as int) as cluster_id",
                                                        "rand(1) as dist_to_centroid",
                                                        "concat('way/', id) as osm_id"), 3)),
    ("Quantiles, first pass: one mergeable sketch per key, combined before the shuffle", sketch_plan()),
    ("G27 duplicate_report: full columns are grouped only for rows whose fingerprint occurs again",
     RG.QUERIES["duplicate_report"](spark, sf)),
    ("G34 threshold_grid: one histogram, suffix sums both ways", RG.QUERIES["threshold_grid"](spark, sf)),
    ("G23 distinct_sketches per date, to be stored and merged",
     RG.Q.distinct_sketches(X.observations(spark, sf, "dense"), ["date"], ["velocity", "osm_id"])),
]
out = ["# Physical plans of representative queries", "",
       "Generated by `explain` (initial AQE plan) at sf0.1 on `local[8]`; regenerate with",
       "`python tests/gen_plans.py > PLANS.md`.", ""]
for title, df in sections:
    out += [f"## {title}", "", "```text", tree(df).rstrip(), "```", ""]
print("\n".join(out))
spark.stop()
