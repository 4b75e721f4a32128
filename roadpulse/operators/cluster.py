"""Standardisation, K-Means and cluster statistics.

What reaches the driver is bounded by model parameters only: one row of
scaling statistics (2 x features numbers), k centroids, k per-cluster sums.
Everything per segment stays distributed.  Cluster ids from a fit are
arbitrary, so readable labels come from a rule on the unscaled cluster means.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.functions.columns import rounded
from roadpulse.operators.quantile import exact_quantiles
from roadpulse.session import materialize
from roadpulse.params import (
    BEHAVIOURAL_FEATURES,
    LABEL_DUAL_PEAK,
    LABEL_EVENING,
    LABEL_FREE_FLOW,
    LABEL_MORNING,
    LABEL_STEADY,
    ClusterParams,
)

FEATURES = list(BEHAVIOURAL_FEATURES)


def scaled_name(c: str) -> str:
    return f"{c}_scaled"


def scale(df: DataFrame, cols: list[str] = FEATURES) -> DataFrame:
    """Standardise by the population sd (as scikit-learn does; Spark ML's
    StandardScaler divides by the sample sd).  A constant column gets scale 1.
    Adds ``<col>_scaled`` columns (H1)."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = []
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        s = 1.0 if (s is None or s == 0.0) else float(s)
        out.append(((F.col(c) - F.lit(float(m or 0.0))) / F.lit(s)).alias(scaled_name(c)))
    return df.select("*", *out)


def scaling_check(scaled: DataFrame, cols: list[str] = FEATURES, digits: int | None = 6) -> DataFrame:
    """Mean and sample sd of each scaled column."""
    long = scaled.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(scaled_name(c)).alias("v")) for c in cols])).alias("s")
    ).select("s.*")
    g = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    # mean of a standardised column is 0 up to float noise; report it rounded
    return g.select("feature", rounded(F.col("mean") + F.lit(0.0), digits).alias("mean"),
                    rounded("std", digits).alias("std"))


def feature_volume_corr(df: DataFrame, cols: list[str] = FEATURES, volume: str = "observation_count",
                        digits: int | None = 3) -> DataFrame:
    """Pearson correlation of each feature with observation volume."""
    row = df.agg(*[F.corr(c, F.col(volume).cast("double")).alias(f"r{i}") for i, c in enumerate(cols)])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), rounded(F.col(f"r{i}"), digits).alias("corr_with_observation_count"))
        for i, c in enumerate(cols)])).alias("s")).select("s.*")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in equal parts, one for each core.  What a fit does with a row (models x centres x passes) does not show
    in the table's bytes, by which Spark would leave a small cohort to one task or a few."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def assemble(scaled: DataFrame, cols: list[str] = FEATURES, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=[scaled_name(c) for c in cols], outputCol=out).transform(scaled)


def _epsilon(tol: float, k: int, mean_variance: float = 1.0) -> float:
    """scikit-learn stops when the summed squared centre shift is at most
    tol x mean feature variance; MLlib stops when every centre moved less than
    epsilon.  epsilon = sqrt(tol x var / k) guarantees the summed criterion
    (standardised features: var = 1)."""
    return (tol * mean_variance / max(k, 1)) ** 0.5


def _fit(vec: DataFrame, k: int, seed: int, max_iter: int, tol: float):
    m = KMeans(k=k, seed=seed, maxIter=max_iter, tol=_epsilon(tol, k), initMode="k-means||",
               featuresCol="features", predictionCol="cluster_id").fit(vec)
    return m, m.summary.trainingCost


def _parallelism(spark, requested: int | None) -> int:
    """Concurrent fits: small cohorts are latency-bound (one task per pass),
    so twice the cores keeps the scheduler busy."""
    return requested or max(2, 2 * spark.sparkContext.defaultParallelism)


class CentroidModel:
    """Centres and cost of a fit; ``transform`` adds ``cluster_id`` (nearest
    centre, computed with column arithmetic over the k literal centres; NULL
    for a fit of an empty cohort, which has no centres)."""

    def __init__(self, centers: list[list[float]], cost: float, cols: list[str]):
        self.centers, self.cost, self.cols = centers, cost, cols

    def clusterCenters(self):  # noqa: N802 - same accessor as the MLlib model
        return self.centers

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.centers:
            return df.withColumn("cluster_id", F.lit(None).cast("int"))
        ds = []
        for cen in self.centers:
            d = None
            for c, v in zip(self.cols, cen):
                t = (F.col(scaled_name(c)) - F.lit(float(v))) * (F.col(scaled_name(c)) - F.lit(float(v)))
                d = t if d is None else d + t
            ds.append(d)
        arr = F.array(*ds)
        return df.withColumn("cluster_id", (F.array_position(arr, F.array_min(arr)) - 1).cast("int"))


def kmeans(scaled: DataFrame, cols: list[str] = FEATURES, k: int = 5, restarts: int = 20, seed: int = 42,
           max_iter: int = 300, tol: float = 1e-4, parallelism: int | None = None):
    """Best-of-``restarts`` MLlib K-Means by inertia (H2).  Returns (model, cost).

    The fits (k-means|| seeding) are independent and submitted concurrently
    from a thread pool, as ``CrossValidator(parallelism=...)`` does.  Ties in
    cost keep the lowest seed.  An empty cohort gives a model without centres."""
    vec = assemble(scaled, cols).select("features").cache()
    try:
        if vec.isEmpty():
            return CentroidModel([], 0.0, cols), 0.0
        with ThreadPoolExecutor(max_workers=min(restarts, _parallelism(scaled.sparkSession, parallelism))) as ex:
            fits = list(ex.map(lambda r: _fit(vec, k, seed + r, max_iter, tol), range(restarts)))
    finally:
        vec.unpersist()
    best = min(range(restarts), key=lambda r: (fits[r][1], r))
    m, cost = fits[best]
    return CentroidModel([list(map(float, c)) for c in m.clusterCenters()], cost, cols), cost


# ---- determined fits: hash-seeded D-squared sampling, then Lloyd's iteration -----
#
# The same input gives the same centres on any cluster.  All restarts (and all k
# of a sweep) are one more dimension of each pass, so a pass is one job whatever
# their number; what comes back to the driver are centres, bounded by parameters.

def seeded_centres(scaled: DataFrame, k: int, restarts: int, seed: int = 42, cols: list[str] = FEATURES,
                   key: str = "osm_id") -> dict[int, list[list[float]]]:
    """Up to ``k`` starting centres for each restart by D-squared sampling.

    A weighted draw is a race: of all rows the one with the least
    -ln(u) / d2 wins, where d2 is the squared distance to the nearest centre so
    far (1 for the first) and u in (0, 1) is a hash of key, seed, restart and
    step.  No state of a random generator depends on the partitioning, and the
    winner is a ``min_by`` of what the batches let through.  The first j centres of a restart are its centres
    for k = j.  Fewer than k centres are found if fewer rows differ."""
    starts: dict[int, list[list[float]]] = {r: [] for r in range(restarts)}
    names = [scaled_name(c) for c in cols]
    drawn = T.StructType([scaled.schema[key], *T.StructType.fromDDL(", ".join(f"`{c}` double" for c in names)), *T.StructType.fromDDL("m long, u double, d2 double")])
    for step in range(k):
        def first(batches, centres={r: list(c) for r, c in starts.items()}):
            """Of each batch and restart the rows that may win: numpy's logarithm is not the JVM's to the last bit."""
            for batch in batches:
                xs = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
                us = batch.column("u").flatten().to_numpy().reshape(len(xs[0]), len(centres))
                for r, found in centres.items():
                    d2 = np.ones(len(xs[0]))
                    if found:
                        d2 = reduce(np.fmin, [sum((x - v) ** 2 for x, v in zip(xs, centre)) for centre in found])
                    can = np.flatnonzero((d2 > 0) | np.isnan(d2))
                    race = -np.log(us[can, r]) / d2[can]
                    can = can[~(race > np.fmin.reduce(race, initial=np.nan) * (1 + 1e-9))]
                    rows = batch.select([key, *names]).take(pa.array(can))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(can), r)), pa.array(us[can, r]), pa.array(d2[can])], names=drawn.names)

        def u(m: Column) -> Column:
            digest = F.md5(F.concat_ws(":", F.col(key), F.lit(str(seed)), m.cast("string"), F.lit(str(step))))
            return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

        rows = scaled.select(key, *names, F.transform(F.array(*map(F.lit, starts)), u).alias("u"))
        raced = rows.mapInArrow(first, drawn).withColumn("race", -F.ln("u") / F.col("d2"))
        won = raced.groupBy("m").agg(F.min_by(F.array(*names), F.struct("race", key)).alias("x")).collect()
        for r in won:
            starts[r["m"]].append(list(r["x"]))
        if len(won) < restarts:
            break
    return starts


def _pass(scaled: DataFrame, models: dict[int, list[list[float]]], cols: list[str]) -> DataFrame:
    """A pass over the rows: for each model ``m`` and centre ``i`` the rows nearest to it (``n``; of equally near centres
    the first has the row), the sums of their features (``x0`` ...) and of their squared distances (``d2``).  Features are
    not null.

    A row is measured against all centres of all models (540 in the default sweep), so the tasks do that with numpy on
    Arrow batches; a task hands over one row for each centre, whatever its rows."""
    centres = {m: np.array(c) for m, c in sorted(models.items())}
    names = [scaled_name(c) for c in cols]
    out = ["m", "i", "n", *[f"x{j}" for j in range(len(cols))], "d2"]

    def measure(batches):
        sums = {m: np.zeros((2 + len(names), len(c))) for m, c in centres.items()}
        for batch in batches:
            xs = [batch.column(name).to_numpy(zero_copy_only=False) for name in names]
            for m, model in centres.items():
                near, best = np.zeros(len(xs[0]), dtype=np.intp), None
                for i, centre in enumerate(model):
                    d2 = sum((x - v) ** 2 for x, v in zip(xs, centre))
                    if best is None:
                        best = d2
                    else:  # NaN is the largest distance, as in Spark
                        closer = (d2 < best) | (np.isnan(best) & ~np.isnan(d2))
                        near[closer] = i
                        best = np.where(closer, d2, best)
                for j, values in enumerate([None, *xs, best]):
                    sums[m][j] += np.bincount(near, values, minlength=len(model))
        held = np.concatenate([[np.full(len(c), m), np.arange(len(c)), *sums[m]] for m, c in centres.items()], axis=1)
        held = held[:, held[2] > 0]
        yield pa.RecordBatch.from_arrays([*map(pa.array, held[:3].astype(np.int64)), *map(pa.array, held[3:])], names=out)

    ddl = "m long, i long, n long, " + ", ".join(f"{c} double" for c in out[3:])
    return scaled.select(*names).mapInArrow(measure, ddl).groupBy("m", "i").agg(*[F.sum(c).alias(c) for c in out[2:]])


def lloyd(scaled: DataFrame, models: dict[int, list[list[float]]], cols: list[str] = FEATURES, max_iter: int = 300,
          tol: float = 1e-4) -> dict[int, tuple[list[list[float]], float]]:
    """(centres, inertia) of each model after Lloyd's iteration from its starting centres.

    A model stops when its centres moved by at most ``tol`` in summed squares
    (the features have variance 1); a centre without rows stays."""
    models = {m: [list(map(float, v)) for v in c] for m, c in models.items() if c}
    active = dict(models)
    for _ in range(max_iter):
        if not active:
            break
        moved = {m: [list(v) for v in c] for m, c in active.items()}
        for r in _pass(scaled, active, cols).collect():
            moved[r["m"]][r["i"]] = [r[f"x{j}"] / r["n"] for j in range(len(cols))]
        for m, c in moved.items():
            shift = sum((a - b) ** 2 for old, new in zip(active[m], c) for a, b in zip(old, new))
            models[m] = c
            if shift <= tol:
                del active[m]
            else:
                active[m] = c
    if not models:
        return {}
    costs = {r["m"]: r["cost"] for r in _pass(scaled, models, cols).groupBy("m").agg(F.sum("d2").alias("cost")).collect()}
    return {m: (c, costs.get(m, 0.0)) for m, c in models.items()}


def best_fits(scaled: DataFrame, ks: list[int], restarts: int, seed: int, cols: list[str] = FEATURES, max_iter: int = 300,
              tol: float = 1e-4) -> dict[int, CentroidModel]:
    """For each k the fit of least inertia among the restarts; equal to 9 decimals, the first of them.  Its centres are
    in order of their coordinates, so that ids do not depend on the restart."""
    starts = seeded_centres(scaled, max(ks), restarts, seed, cols)
    fits = lloyd(scaled, {k * restarts + r: c[:k] for k in ks for r, c in starts.items()}, cols, max_iter, tol)
    out = {}
    for k in ks:
        ranked = sorted((round(fits[m][1], 9), r, m) for r in range(restarts) if (m := k * restarts + r) in fits)
        centres, cost = fits[ranked[0][2]] if ranked else ([], 0.0)
        out[k] = CentroidModel(sorted(centres), cost, cols)
    return out


def with_centroid_distance(df: DataFrame, centroids: list[list[float]], cols: list[str] = FEATURES,
                           cluster_col: str = "cluster_id") -> DataFrame:
    """Euclidean distance of each row to its own centroid in scaled space (H5).
    The k centroids are literals (bounded by k), so no join is needed."""
    if not centroids:
        return df.withColumn("dist_to_centroid", F.lit(None).cast("double"))
    idx = F.col(cluster_col) + 1
    sq = None
    for j, c in enumerate(cols):
        cj = F.element_at(F.array(*[F.lit(float(cen[j])) for cen in centroids]), idx)
        term = (F.col(scaled_name(c)) - cj) * (F.col(scaled_name(c)) - cj)
        sq = term if sq is None else sq + term
    return df.withColumn("dist_to_centroid", F.sqrt(sq))


def group_centroids(df: DataFrame, cols: list[str] = FEATURES, cluster_col: str = "cluster_id") -> DataFrame:
    """Centroids as per-cluster means of the scaled features (k rows)."""
    return df.groupBy(cluster_col).agg(*[F.avg(scaled_name(c)).alias(scaled_name(c)) for c in cols])


def with_group_centroid_distance(df: DataFrame, cols: list[str] = FEATURES, cluster_col: str = "cluster_id") -> DataFrame:
    """Distance to the mean of the row's own group (fixed assignments)."""
    cents = group_centroids(df, cols, cluster_col).select(
        cluster_col, *[F.col(scaled_name(c)).alias(f"__c_{c}") for c in cols])
    j = df.join(F.broadcast(cents), cluster_col)  # k rows: bounded by the number of clusters
    sq = None
    for c in cols:
        d = F.col(scaled_name(c)) - F.col(f"__c_{c}")
        sq = d * d if sq is None else sq + d * d
    return j.withColumn("dist_to_centroid", F.sqrt(sq)).drop(*[f"__c_{c}" for c in cols])


def silhouette_sq_euclidean(df: DataFrame, cols: list[str] = FEATURES, cluster_col: str = "cluster_id") -> DataFrame:
    """Mean silhouette with squared Euclidean dissimilarity, exact, in O(n k) (H4).

    sum_j ||x - y_j||^2 over a cluster C = n_C ||x||^2 - 2 x . S_C + Q_C, with
    S_C the vector sum and Q_C the sum of squared norms, so the k cluster
    summaries (collected: k rows) replace the all-pairs distance matrix.
    a(i) excludes the point itself; a singleton cluster scores 0.
    The Euclidean (non-squared) silhouette has no such decomposition and would
    need every pair; it is not offered."""
    xs = [F.col(scaled_name(c)) for c in cols]
    norm2 = sum((x * x for x in xs[1:]), xs[0] * xs[0])
    summ = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n"), F.sum(norm2).alias("q"),
                                       *[F.sum(x).alias(f"s{j}") for j, x in enumerate(xs)]).collect()
    summ = sorted(summ, key=lambda r: r[cluster_col])
    if not summ:
        return df.select(F.lit(None).cast("double").alias("s")).agg(F.avg("s").alias("silhouette"))
    own = F.col(cluster_col)
    totals, a, b = [], None, None
    for i, r in enumerate(summ):
        cid, n = r[cluster_col], int(r["n"])
        dot = sum((xs[j] * F.lit(float(r[f"s{j}"])) for j in range(1, len(xs))), xs[0] * F.lit(float(r["s0"])))
        totals.append((F.lit(float(n)) * F.col("__norm2") - F.lit(2.0) * dot + F.lit(float(r["q"]))).alias(f"__t{i}"))
        a_c = F.when(own == F.lit(cid), F.col(f"__t{i}") / F.lit(float(max(n - 1, 1))))
        a = a_c if a is None else F.coalesce(a, a_c)
        b_c = F.when(own != F.lit(cid), F.col(f"__t{i}") / F.lit(float(n)))
        b = b_c if b is None else F.least(b, b_c)
    size = F.element_at(F.create_map(*[x for r in summ for x in (F.lit(r[cluster_col]), F.lit(int(r["n"])))]), own)
    # a step each: in one expression every mention of a and b would hold all totals again, in a method too long to compile
    rows = df.select(cluster_col, *xs, norm2.alias("__norm2")).select(cluster_col, *totals).select(size.alias("size"), a.alias("a"), b.alias("b"))
    s = F.when((F.col("size") <= 1) | F.col("b").isNull(), F.lit(0.0)).otherwise(
        F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return rows.select(F.coalesce(s, F.lit(0.0)).alias("s")).agg(F.avg("s").alias("silhouette"))


# ---------------------------------------------------------------------------
# labels
# ---------------------------------------------------------------------------
def cluster_means(df: DataFrame, cols: list[str] = FEATURES, cluster_col: str = "cluster_id") -> DataFrame:
    return df.groupBy(cluster_col).agg(*[F.avg(c).alias(c) for c in cols])


def label_clusters(means: DataFrame, cluster_col: str = "cluster_id") -> DataFrame:
    """Readable label per cluster from unscaled cluster means (H6, B14):
    highest mean AM slowdown -> morning-peak; highest PM slowdown of the rest
    -> evening-peak; highest median velocity of the rest -> free-flow; of the
    rest, the larger AM+PM slowdown -> dual-peak; others -> steady.  Ties
    break on the lower cluster id.  Each step is a rank over the k-row means
    frame (a single small partition by construction)."""
    c = F.col(cluster_col)
    r1 = Window.orderBy(F.col("am_relative_slowdown").desc(), c)
    m = means.withColumn("_r1", F.row_number().over(r1))
    r2 = Window.orderBy(F.when(F.col("_r1") == 1, 1).otherwise(0), F.col("pm_relative_slowdown").desc(), c)
    m = m.withColumn("_r2", F.row_number().over(r2))
    done2 = (F.col("_r1") == 1) | (F.col("_r2") == 1)
    r3 = Window.orderBy(F.when(done2, 1).otherwise(0), F.col("median_velocity").desc(), c)
    m = m.withColumn("_r3", F.row_number().over(r3))
    done3 = done2 | (F.col("_r3") == 1)
    both = F.col("am_relative_slowdown") + F.col("pm_relative_slowdown")
    r4 = Window.orderBy(F.when(done3, 1).otherwise(0), both.desc(), c)
    m = m.withColumn("_r4", F.row_number().over(r4))
    label = (F.when(F.col("_r1") == 1, LABEL_MORNING).when(F.col("_r2") == 1, LABEL_EVENING)
             .when(F.col("_r3") == 1, LABEL_FREE_FLOW).when(F.col("_r4") == 1, LABEL_DUAL_PEAK)
             .otherwise(LABEL_STEADY))
    return m.select(c.cast("int").alias(cluster_col), label.alias("cluster_label"))


# ---------------------------------------------------------------------------
# composite results
# ---------------------------------------------------------------------------
CLUSTER_COLUMNS = (
    "osm_id", "cluster_id", "cluster_label", "dist_to_centroid", "median_velocity", "velocity_std",
    "am_relative_slowdown", "pm_relative_slowdown", "am_slowdown_frequency", "pm_slowdown_frequency",
    "observation_count", "active_days", "zero_velocity_observation_count",
)


def segment_clusters(features: DataFrame, params: ClusterParams = ClusterParams(), digits: int | None = 4,
                     initial: list[list[float]] | None = None):
    """Complete cohort -> scale -> K-Means (best of hash-seeded restarts, or from
    ``initial`` centres) -> distance to own centroid -> rule labels (C6).
    Returns (clusters DataFrame, model, cost).  ``params.seeding='mllib'`` takes
    MLlib's randomly seeded fits instead."""
    cols = list(params.features)
    scaled = materialize(dealt(scale(features.na.drop("any"), cols)), "scaled-cohort")
    if initial is not None:
        fits = lloyd(scaled, {0: initial}, cols, params.max_iter, params.tol)
        model = CentroidModel(*fits[0], cols) if fits else CentroidModel([], 0.0, cols)
    elif params.seeding == "mllib":
        model, _ = kmeans(scaled, cols, k=params.k, restarts=params.restarts, seed=params.seed,
                          max_iter=params.max_iter, tol=params.tol)
    else:
        model = best_fits(scaled, [params.k], params.restarts, params.seed, cols, params.max_iter, params.tol)[params.k]
    cost = model.cost
    assigned = model.transform(scaled)
    assigned = with_centroid_distance(assigned, [list(c) for c in model.clusterCenters()], cols)
    labels = label_clusters(cluster_means(assigned, cols))
    out = assigned.join(F.broadcast(labels), "cluster_id")  # k rows
    out = out.select(*[rounded(c, digits).alias(c) if c == "dist_to_centroid" else F.col(c)
                       for c in CLUSTER_COLUMNS])
    return out, model, cost


def k_sweep(features: DataFrame, params: ClusterParams = ClusterParams(), digits: int | None = 4,
            initial: dict[int, list[list[float]]] | None = None, parallelism: int | None = None) -> DataFrame:
    """Inertia and squared-Euclidean silhouette for each k (C12, H3): best of
    ``sweep_restarts``, or, for the k in ``initial``, from those centres.  All
    fits share their passes; the silhouettes are submitted together."""
    cols = list(params.features)
    scaled = materialize(dealt(scale(features.na.drop("any"), cols).select("osm_id", *[scaled_name(c) for c in cols])), "k-sweep")
    spark = features.sparkSession
    if initial is not None:
        models = {k: CentroidModel(*fit, cols) for k, fit in lloyd(scaled, initial, cols, params.max_iter, params.tol).items()}
    elif params.seeding == "mllib":
        models = {k: kmeans(scaled, cols, k=k, restarts=params.sweep_restarts, seed=params.seed, max_iter=params.max_iter,
                            tol=params.tol, parallelism=parallelism)[0] for k in params.sweep_k}
    else:
        models = best_fits(scaled, list(params.sweep_k), params.sweep_restarts, params.seed, cols, params.max_iter, params.tol)

    def score(k):
        sil = silhouette_sq_euclidean(models[k].transform(scaled), cols).first()["silhouette"] if models[k].centers else None
        return int(k), float(models[k].cost), float(sil) if sil is not None else None

    with ThreadPoolExecutor(max_workers=max(1, min(len(models), _parallelism(spark, parallelism)))) as ex:
        rows = list(ex.map(score, sorted(models)))
    df = spark.createDataFrame(rows, "k int, inertia double, silhouette double")
    return df.select("k", rounded("inertia", digits).alias("inertia"),
                     rounded("silhouette", digits).alias("silhouette_score"))


def cluster_sizes(clusters: DataFrame, digits: int | None = 1) -> DataFrame:
    """Segments per cluster and percent of the cohort."""
    g = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("segment_count"))
    total = g.agg(F.sum("segment_count")).scalar()
    return g.select("cluster_id", "segment_count",
                    rounded(F.try_divide(F.col("segment_count") * 100.0, total), digits).alias("pct_of_cohort"))


def cluster_profile(clusters: DataFrame, digits: int | None = 2) -> DataFrame:
    """Per cluster: size, mean/sd/median of behavioural features, mean volume."""
    g = clusters.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("median_velocity").alias("median_vel_mean"),
        F.stddev_samp("median_velocity").alias("median_vel_std"),
        F.avg("am_relative_slowdown").alias("am_slowdown_mean"),
        F.avg("am_slowdown_frequency").alias("am_freq_mean"),
        F.avg("pm_relative_slowdown").alias("pm_slowdown_mean"),
        F.avg("pm_slowdown_frequency").alias("pm_freq_mean"),
        F.avg("velocity_std").alias("vel_std_mean"),
        F.avg("observation_count").alias("avg_obs_count"),
        F.avg("active_days").alias("avg_active_days"))
    meds = grouped_medians(clusters, ["cluster_id"], {"am_relative_slowdown": "am_slowdown_median",
                                                      "pm_relative_slowdown": "pm_slowdown_median"})
    j = g.join(meds, "cluster_id", "left")
    cols = ["median_vel_mean", "median_vel_std", "am_slowdown_mean", "am_slowdown_median", "am_freq_mean",
            "pm_slowdown_mean", "pm_slowdown_median", "pm_freq_mean", "vel_std_mean", "avg_obs_count",
            "avg_active_days"]
    return j.select("cluster_id", "count", *[rounded(c, digits).alias(c) for c in cols])


def grouped_medians(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """Exact medians of several columns per group in one quantile pass
    (columns unpivoted to (feature, value)), pivoted back to named columns."""
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("s")
    ).select(*keys, "s.feature", "s.value")
    q = exact_quantiles(long, keys + ["feature"], "value", [0.5], names=["m"])
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(nm)
                                  for c, nm in columns.items()])


def cluster_boxplot(clusters: DataFrame, cols: list[str] = FEATURES, digits: int | None = 4) -> DataFrame:
    """Box-plot statistics per (cluster, feature): quartiles, whiskers at the
    most extreme values within 1.5 IQR, outlier count (G42)."""
    long = clusters.select("cluster_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])).alias("s")
    ).select("cluster_id", "s.feature", "s.value").where(F.col("value").isNotNull())
    keys = ["cluster_id", "feature"]
    q = exact_quantiles(long, keys, "value", [0.25, 0.5, 0.75], names=["q1", "median", "q3"])
    j = long.join(q, keys)
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    v = F.col("value")
    g = j.groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(v >= lo, v)).alias("whisker_low"), F.max(F.when(v <= hi, v)).alias("whisker_high"),
        F.count_if((v < lo) | (v > hi)).alias("outliers"))
    return g.select(*keys, *[rounded(c, digits).alias(c) for c in ("q1", "median", "q3")],
                    rounded(F.col("q3") - F.col("q1"), digits).alias("iqr"),
                    rounded("whisker_low", digits).alias("whisker_low"),
                    rounded("whisker_high", digits).alias("whisker_high"), "outliers")


def nearest_to_centroid(clusters: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` segments closest to each centroid (W3).  ``row_number() <= n``
    lets Spark apply a per-partition group limit before the shuffle, so a large
    cluster never sorts in one task."""
    w = Window.partitionBy("cluster_id").orderBy("dist_to_centroid", "osm_id")
    return clusters.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
