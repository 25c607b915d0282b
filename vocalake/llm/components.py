"""Connected components of undirected edges by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node of the edges ``a, b``.

    Each round links the larger neighbours of a node to its smallest neighbour, then the smaller ones;
    rounds repeat until the edges stay as they are, a logarithmic number. Edges live in stored tables
    only; a node with many edges is an aggregate and a join that the adaptive planner splits. An empty
    table gives no rows; edges with a null end are left out.
    """
    links = stored(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (state := links.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("hash")).first()) != before:
        before = state
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        links = stored(small_star(large_star(both)))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()


def large_star(both: DataFrame) -> DataFrame:
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("least"))
    near = links.join(least, "a")
    return near.filter("b > least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
        least.select("a", F.col("least").alias("b"))
    ).distinct()
