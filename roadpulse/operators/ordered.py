"""Running totals and running last values over an order that no single task holds.

A window over a key keeps all rows of that key in one task; a key with a third
of the rows, or an order over the whole table (no key), makes that task the
bottleneck.  Here the rows are range-partitioned by (keys, order) and written
with the number of their partition, each partition runs its own window, and
what the partitions before it leave behind (one row per partition and key) is
added.  A partition boundary may fall inside a key.

Rows that agree in keys and order stay in one partition, so the order should
tell repeated rows apart where there may be many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from roadpulse.session import materialize

PART = "__part"


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, before: bool = False) -> DataFrame:
    """``df`` with, per key in ``order``, the running sum of each of ``sums`` (nulls count 0) and the latest
    value that is not null of each of ``lasts``: up to and with the row, or without it (``before``)."""
    sums, lasts = sums or {}, lasts or {}
    given = df.select("*", *[F.coalesce(c, F.lit(0)).alias(f"__s_{n}") for n, c in sums.items()],
                      *[c.alias(f"__l_{n}") for n, c in lasts.items()])
    dealt = given.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order)
    base = materialize(dealt.withColumn(PART, F.spark_partition_id()), "ordered")

    inside = W.partitionBy(PART, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    whole = W.partitionBy(PART, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = base.select("*", *[F.coalesce(F.sum(f"__s_{n}").over(inside), F.lit(0)).alias(f"__r_{n}") for n in sums],
                        *[F.last(f"__l_{n}", ignorenulls=True).over(inside).alias(f"__r_{n}") for n in lasts])

    ends = base
    if lasts:
        ends = base.select("*", F.row_number().over(W.partitionBy(PART, *keys).orderBy(*order)).alias("__n"),
                           *[F.last(f"__l_{n}", ignorenulls=True).over(whole).alias(f"__e_{n}") for n in lasts])
    ends = ends.groupBy(PART, *keys).agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(f"__s_{n}").alias(f"__e_{n}") for n in sums],
                                         *[F.max_by(f"__e_{n}", "__n").alias(f"__e_{n}") for n in lasts])
    past = W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    left = ends.select(PART, *keys, F.count(F.lit(1)).over(past).alias("__past"),
                       *[F.sum(f"__e_{n}").over(past).alias(f"__o_{n}") for n in sums],
                       *[F.last(f"__e_{n}", ignorenulls=True).over(past).alias(f"__o_{n}") for n in lasts])
    # only keys that go over a boundary: fewer rows than partitions
    left = left.where(F.col("__past") > 0).select(F.col(PART).alias("__p"), *[F.col(k).alias(f"__k_{k}") for k in keys],
                                                  *[f"__o_{n}" for n in [*sums, *lasts]])
    left = materialize(left, "ordered-edges")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col(PART) == F.col("__p"))
    return local.join(left, same, "left").select(
        *df.columns, *[(F.col(f"__r_{n}") + F.coalesce(f"__o_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(f"__r_{n}", f"__o_{n}").alias(n) for n in lasts])
