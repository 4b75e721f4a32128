"""Exact grouped quantiles, led by a sketch.

``percentile``/``median`` keep every distinct value of a group in one
aggregation buffer; with one segment holding a third of all rows that buffer
would hold a third of the data.  Here one pass aggregates a mergeable KLL
sketch per key, which tells a narrow range of values around each wanted rank.
A second pass counts the rows of each cell between the ranges and, inside them,
the rows of each value; a running sum of those counts over range partitions
(``operators.ordered``) gives the exact rank of every value inside.  A rank
that falls between the ranges, as the sketch's error allows for now and then,
names the cell that holds it, which is the range of the next pass; so there are
one or two of them.  All groups, of any size, go this one way.

What is shuffled are sketches, counts and the values inside the ranges, which
for a large group are its rows times the sketch's error.  Nothing is cached:
``df`` is read twice, so write it first if it is costly.

Interpolation is the linear rule of pandas/DuckDB ``quantile_cont``:
x[lo] + (h - lo) * (x[hi] - x[lo]) with h = (n - 1) * p, and the value itself
where both order statistics are equal (also both infinite).  NULL values are
ignored; NaN is the largest value.  A key without values has no row.  With a
``weight`` (an integer column) a row stands for that many equal values, and
rows of weight 0 for none; the sketch then leads less closely, the counts do
the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.operators.ordered import running
from roadpulse.session import materialize

#: Parameter of the sketch (ranks off by about half a percent of a group's rows in one of a hundred groups), and the share
#: of the rows on either side of a rank that the range takes in.
SKETCH_K, MARGIN = 1000, 0.01


def _same_keys(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__r_{k}" for k in keys})


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _sketched(base: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Per key: ``n`` values, ``m`` that are no NaN, and for each probability the ranks ``a``, ``b`` around it and the range ``lo``, ``hi``."""
    solid = F.when(~F.isnan("__v"), F.col("__v"))
    stats = base.groupBy(*keys).agg(F.sum("__w").alias("n"), F.coalesce(F.sum(F.when(solid.isNotNull(), F.col("__w"))), F.lit(0)).alias("m"),
                                    F.kll_sketch_agg_double(solid, F.lit(SKETCH_K)).alias("sketch"))
    out = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1).cast("double") * F.lit(float(p))
        a, b = F.floor(h), F.ceil(h)
        # of a group of fewer rows than the margin can tell apart, all values are in the range
        read = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
        edge = lambda q, end: F.when(F.col("m") > 0, F.when(F.col("n") * MARGIN >= 2, read(q)).otherwise(read(end)))
        out += [a.alias(f"a{i}"), b.alias(f"b{i}"), (h - a).alias(f"f{i}"),
                edge(max(p - MARGIN, 0.0), 0.0).alias(f"lo{i}"), edge(min(p + MARGIN, 1.0), 1.0).alias(f"hi{i}")]
    return materialize(stats.select(*keys, "n", "m", *out), "quantile-ranges")


def _counted(base: DataFrame, ranges: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Per key, in order of value: rows of each cell between the ranges and of each value inside, the rows up to and with
    it (``upto``), and the least and largest value (``low``, ``high``)."""
    cuts = [c for i in range(n) for c in (f"lo{i}", f"hi{i}")]
    rows = base.join(_renamed(ranges.select(*keys, *cuts), keys), _same_keys(keys))
    v = F.col("__v")
    # a cell is a value of a cut or the values between two cuts
    cell = sum([F.when(v >= F.col(c), 1).otherwise(0) + F.when(v > F.col(c), 1).otherwise(0) for c in cuts], F.lit(0))
    inside = F.when(_any([(v >= F.col(f"lo{i}")) & (v <= F.col(f"hi{i}")) for i in range(n)]), v)
    cells = rows.select(*keys, cell.alias("cell"), inside.alias("x"), v, "__w").groupBy(*keys, "cell", "x").agg(
        F.sum("__w").alias("c"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    return running(cells, keys, [F.col("cell").asc(), F.col("x").asc_nulls_first()], {"upto": F.col("c")})


def _looked_up(counts: DataFrame, ranges: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``ranges`` with the value of each rank (``x_a0`` ...) and, where a rank is in a cell between the ranges, that cell's bounds."""
    ranks = [f"{w}{i}" for i in range(n) for w in ("a", "b")]
    rows = counts.join(_renamed(ranges.select(*keys, *ranks), keys), _same_keys(keys))
    aggs = []
    for r in ranks:
        here = (F.col(r) >= F.col("upto") - F.col("c")) & (F.col(r) < F.col("upto"))
        missed = here & F.col("x").isNull()
        aggs += [F.max(F.when(here, F.col("x"))).alias(f"x_{r}"), F.min(F.when(missed, F.col("low"))).alias(f"low_{r}"),
                 F.max(F.when(missed, F.col("high"))).alias(f"high_{r}")]
    # at most one row for each rank
    hit = _any([(F.col(r) >= F.col("upto") - F.col("c")) & (F.col(r) < F.col("upto")) for r in ranks])
    found = rows.where(hit).groupBy(*keys).agg(*aggs)
    return ranges.join(_renamed(found, keys), _same_keys(keys)).drop(*[f"__r_{k}" for k in keys])


def exact_quantiles(df: DataFrame, keys: list[str] | tuple[str, ...], value: str, probs: list[float],
                    names: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """One row per key with one column per probability (``names``), exact; without keys one row, if there is a value."""
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    keys, no_keys, n = list(keys) or ["__all"], not keys, len(probs)
    if no_keys:
        df = df.withColumn("__all", F.lit(0))
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    base = df.select(*keys, F.col(value).cast("double").alias("__v"), w.alias("__w")).where(F.col("__v").isNotNull() & (F.col("__w") > 0))
    ranges = _sketched(base, keys, probs)
    ranks = [f"{w}{i}" for i in range(n) for w in ("a", "b")]
    out = None
    for last in (False, True):
        found = materialize(_looked_up(_counted(base, ranges, keys, n), ranges, keys, n), "quantile-values")
        # ranks beyond the values that are no NaN need no look-up
        missed = _any([(F.col(r) < F.col("m")) & F.col(f"x_{r}").isNull() for r in ranks])
        done = found if last else found.where(~missed)
        out = done if out is None else out.unionByName(done)
        again = found.where(missed)
        if last or again.isEmpty():
            break
        # ranges grow to the cells that hold the ranks
        again = again.select(*keys, "n", "m", *[c for i in range(n) for c in (
            f"a{i}", f"b{i}", f"f{i}", F.least(f"lo{i}", f"low_a{i}", f"low_b{i}").alias(f"lo{i}"),
            F.greatest(f"hi{i}", f"high_a{i}", f"high_b{i}").alias(f"hi{i}"))])
        ranges = materialize(again, "quantile-ranges")
        wanted = _renamed(ranges.select(*keys), keys)
        base = base.join(wanted, _same_keys(keys), "left_semi")

    def at(r: str) -> Column:
        return F.when(F.col(r) >= F.col("m"), F.lit(float("nan"))).otherwise(F.col(f"x_{r}"))

    cols = []
    for i, name in enumerate(names):
        a, b = at(f"a{i}"), at(f"b{i}")
        cols.append(F.when((a == b) | (F.col(f"f{i}") == 0), a).otherwise(a + F.col(f"f{i}") * (b - a)).alias(name))
    return out.select(*([] if no_keys else keys), *cols)


def exact_median(df: DataFrame, keys, value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5], names=[name])
