"""Running sums and last values over range partitions equal plain windows."""
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadpulse.operators.ordered import running

ROWS = [(k, t, (k or 0) * 100 + t if t % 3 else None) for k in (None, 1, 2, 3) for t in range(7)] + [(9, t, t if t % 50 == 7 else None) for t in range(400)]


def plain(df, keys, order, before):
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    return df.select("*", F.coalesce(F.sum(F.coalesce("v", F.lit(0))).over(w), F.lit(0)).alias("s"), F.last("v", ignorenulls=True).over(w).alias("l"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_running_over_boundaries(spark):
    df = spark.createDataFrame(ROWS, "k int, t int, v int").repartition(5)
    up, down = [F.col("k").asc(), F.col("t").asc()], [F.col("k").desc(), F.col("t").desc()]
    for keys, order, before in ((["k"], up, False), (["k"], down, True), ([], up, True), ([], down, False)):
        got = running(df, keys, order, {"s": F.col("v")}, {"l": F.col("v")}, before)
        assert got.columns == ["k", "t", "v", "s", "l"]
        assert rows(got) == rows(plain(df, keys, order, before))


def test_running_of_nothing(spark):
    got = running(spark.createDataFrame([], "k int, t int"), ["k"], [F.col("t").asc()], {"s": F.lit(1)}, {"l": F.col("t")})
    assert got.collect() == []
