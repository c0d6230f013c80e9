"""Connected components, greedy independent sets and one-to-one assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import checkpointed


def _stars(pairs: DataFrame) -> bool:
    """Whether each node of (u, v) either hangs on one other or has others on it: then v names the component."""
    ends = pairs.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up + down > 1").agg(F.count(F.lit(1))).first()[0] == 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is its smallest node.

    Alternates the large-star and small-star steps, which need O(log^2 n) rounds even on long
    chains, until all components are stars, and cuts the lineage through the checkpoint folder in
    each round. Minima are partial aggregates; they are checkpointed, so that both sides of the join
    that takes them back come from plain exchanges and adaptive execution can split a hub, which
    else meets in one task. Self loops and nulls are ignored: a node without another has no row.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    pairs = checkpointed(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        if _stars(pairs):
            break
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(large)
        small_low = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(small_low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        pairs = checkpointed(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
    else:
        raise RuntimeError(f"components are no stars after {max_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
