"""Connected components of a large edge table.

Alternating large-star and small-star rounds: each node's neighbours are hung on
the smallest of them until every component is a star.  A round is two grouped
minima and two joins, written as a table (which also cuts the lineage); the
number of rounds grows with the logarithm of the longest chain.  Nothing but a
row count and a checksum per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the (a, b) edges; label is the smallest node reachable."""
    star = materialize(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "component-edges")
    if star.isEmpty():
        return star.select(F.col("u").alias("node"), F.col("v").alias("label"))
    seen = None
    while True:
        star = materialize(small_star(materialize(large_star(star), "component-stars")), "component-stars")
        state = star.agg(F.count(F.lit(1)).alias("n"),
                         F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if state == seen:
            break
        seen = state
    return star.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        star.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
    # written, so that a node with very many neighbours can be split in the join
    least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "component-least")
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(
        F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of them."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "component-least")
    hung = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()
