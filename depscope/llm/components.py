"""Connected components of a distributed edge list (alternating large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is tied to the least of u and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its lower neighbours are tied to the least of them (edges run from the greater to the lesser)."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    tied = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return tied.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reachable.

    Loops and repeated edges are allowed; no edges give no rows. Rounds grow with the logarithm of the longest chain;
    what each leaves is written to the shared folder. Nothing but two numbers per round reaches the driver.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b"), F.col("b")).distinct())
        before, last = tuple(state), edges
        edges = written(_small_star(_large_star(last)), "edges")
        release(last)
