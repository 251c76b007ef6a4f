"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise, released


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    joined = both.join(least, both.a == least.u).filter("b > a")
    return joined.select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u")
    joined = edges.join(least, edges.b == least.u)
    return joined.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(least.select(F.col("m").alias("x"), F.col("u").alias("y"))).filter("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root of every node of a link table (a < b); the root is the smallest node of its component.

    Rounds end when every node has one link, to a node that has none above it. Each round is written to the shared
    folder, so a lost executor never costs more than one round. An empty table gives an empty result.
    """
    now = edges
    for _ in range(most_rounds):
        before, now = now, materialise(_small_star(_large_star(now)), "components")
        if before is not edges:
            released(before)
        parents = now.groupBy("b").agg(F.count("*").alias("n"))
        chained = now.select(F.col("a").alias("b")).distinct().join(now.select("b").distinct(), "b")
        if not parents.filter("n > 1").limit(1).count() and not chained.limit(1).count():
            stars = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
            return stars.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
