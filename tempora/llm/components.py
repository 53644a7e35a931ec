"""Connected components by alternating large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, written

#: Rounds after which the loop gives up; each round at least halves the longest chain.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. ``edges`` (u, v) with u > v, each once. Every node's neighbours are tied to the smallest of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        out = both.join(apart(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("low"))
        moved = edges.join(apart(low), "u")
        out = moved.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; ``edges``: (a long, b long). The component is its smallest node."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    for _ in range(MOST_ROUNDS):
        edges = written(edges, "stars")
        # Settled: every node has one edge to a smaller node, which has none itself.
        ends = edges.select("u", F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("n"), F.lit(1).alias("m")))
        if ends.groupBy("u").agg(F.sum("n").alias("n"), F.max("m").alias("m")).filter("n > 1 or n > 0 and m > 0").isEmpty():
            break
        edges = _star(_star(edges, True), False)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
