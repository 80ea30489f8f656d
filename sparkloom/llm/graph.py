"""Connected components of a distributed graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, table


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (columns a, b).

    Large-star and small-star steps by turns: each node's neighbours are hung onto its smallest neighbour, till nothing
    changes; the number of rounds is about the logarithm of the number of nodes. Only sums of edges reach the driver. A node with very many neighbours
    is pre-aggregated before the shuffle, and its rows are split by adaptive skew joins. Self-loops and repeats don't matter.
    """
    pair = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    state, before = table(pair), None
    for _ in range(rounds):
        # large star: to all larger neighbours, the smallest of the neighbourhood
        both = state.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(state.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: to all smaller neighbours and the node itself, the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        old, state = state, table(large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        forget(old)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    nodes = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
