"""Exact quantiles against numpy, including forced second passes."""
import numpy as np
import pandas as pd
import pytest

from roadpulse.operators import quantile
from roadpulse.operators.quantile import exact_quantiles

PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]
NAMES = ["p0", "p25", "p50", "p75", "p100"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 2000
    pdf = pd.DataFrame({"k": rng.choice(["hot", "b", "c", "const"], n, p=[0.7, 0.1, 0.1, 0.1]),
                        "v": np.round(rng.exponential(20, n), 2)})
    pdf.loc[pdf.k == "const", "v"] = 5.0
    pdf.loc[:3, "v"] = np.nan
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("sketch,margin", [(1000, 0.01), (8, 0.002), (8, 0.01)])
def test_matches_numpy(data, monkeypatch, sketch, margin):
    """Also where a coarse sketch misses ranks and a second pass is made."""
    monkeypatch.setattr(quantile, "SKETCH_K", sketch)
    monkeypatch.setattr(quantile, "MARGIN", margin)
    pdf, df = data
    got = exact_quantiles(df, ["k"], "v", PROBS, names=NAMES).toPandas().set_index("k").sort_index()
    exp = pdf.dropna().groupby("k")["v"].quantile(PROBS).unstack()
    assert np.allclose(got[NAMES].values, exp.values, rtol=0, atol=1e-9)


def test_weighted_and_global(spark):
    w = pd.DataFrame({"v": [0.0, 3.0, 7.0, 1.5, 99.0], "w": [500, 1, 2, 1, 0]})
    got = exact_quantiles(spark.createDataFrame(w), [], "v", [0.25, 0.5, 0.9, 0.998], names=["a", "b", "c", "d"], weight="w").first()
    assert np.allclose(list(got), np.quantile(np.repeat(w.v, w.w), [0.25, 0.5, 0.9, 0.998]))


def test_infinities_and_nan(spark):
    """Infinite values are values; NaN is the largest; equal order statistics are not subtracted."""
    inf, nan = float("inf"), float("nan")
    rows = [("i", v) for v in (-inf, -inf, 1.0, 2.0, inf, inf)] + [("n", v) for v in (1.0, 3.0, nan, nan)] + [("a", nan)] + [(None, v) for v in (5.0, None, 6.0)]
    got = {r.k: list(r)[1:] for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.0, 0.1, 0.5, 1.0],
                                                     names=["a", "b", "c", "d"]).collect()}
    assert got["i"] == [-inf, -inf, 1.5, inf]
    assert got["n"][0] == 1.0 and got["n"][1] == pytest.approx(1.6) and np.isnan(got["n"][2:]).all()
    assert np.isnan(got["a"]).all() and got[None] == [5.0, 5.1, 5.5, 6.0]


def test_hot_key(spark):
    """One key with nearly all rows, most of them one value."""
    df = spark.range(60_000).selectExpr("IF(id % 100 = 0, id % 7, 0) AS k", "CAST(IF(id % 3 = 0, id, 17) AS DOUBLE) AS v")
    pdf = df.toPandas()
    got = exact_quantiles(df, ["k"], "v", PROBS, names=NAMES).toPandas().set_index("k").sort_index()
    assert np.allclose(got[NAMES].values, pdf.groupby("k")["v"].quantile(PROBS).unstack().values)


def test_single_row_and_empty(spark):
    one = spark.createDataFrame([("a", 3.5)], "k string, v double")
    assert exact_quantiles(one, ["k"], "v", [0.5], names=["m"]).first()["m"] == 3.5
    empty = spark.createDataFrame([], "k string, v double")
    assert exact_quantiles(empty, ["k"], "v", [0.5], names=["m"]).count() == 0
