"""Connected components over an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabspark.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them; edges come as u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns u, v: long), root being the smallest node reachable.

    A node that is a root itself isn't listed.  Each round is written to the
    shared folder; rounds grow with the logarithm of the longest chain, and a
    hot node's edges meet in a join whose partitions adaptive execution splits.
    """
    state = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    state, before = materialize(state, "edges"), None
    while True:
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first()
        if now == before or now[0] == 0:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        state = materialize(_small_star(_large_star(state)), "edges")
