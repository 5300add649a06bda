"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(a, b) -> (node, component): the least node reachable, for every node with an edge to another one.

    Each round links every node to the least neighbour known (partial aggregates and plain equi-joins, never a node's
    neighbour list in one place), until the edges no longer change: then each node hangs on its component's least.
    Rounds are written to the shared folder, so lineage stays short; there are about log2 of the longest chain.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = scratch.save(edges.where("a != b").select(high.alias("u"), low.alias("v")).distinct(), f"{label}-0")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen, k = mark(now), 0
    while seen[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        k += 1
        after = scratch.save(small.distinct(), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
        now, had = after, seen
        seen = mark(now)
        if seen == had:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
