"""Exact and near duplicates: representatives, blocked theta joins, isolation, greedy sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.graph import connected_components
from weftline.session import checkpointed

#: Gates of the isolation from a test set, and inside a scene: Hamming alone, Hamming with cosine.
ISOLATION = (8, 16, 0.88)
IN_SCENE = (10, 18, 0.85)


def near(hamming: Column, cosine: Column, gate: tuple[int, int, float]) -> Column:
    """Text similarity never decides alone: it only widens the Hamming gate."""
    alone, widened, least = gate
    return (hamming <= alone) | ((hamming <= widened) & (cosine >= least))


def first_in_group(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group; Spark prunes each partition to ``n`` before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def one_per_text(df: DataFrame, by: list[str], pick: str) -> DataFrame:
    """One row per group, the smallest ``pick``: a partial aggregate, so hot texts stay cheap."""
    rest = [c for c in df.columns if c not in by and c != pick]
    return df.groupBy(*by).agg(F.min(F.struct(pick, *rest)).alias("_m")).select(*by, "_m.*")


def blocked_pairs(df: DataFrame, key: str, block: list[Column], within: Callable[[str, str], Column]) -> DataFrame:
    """(a, b) with a < b, in one block, that satisfy ``within(left alias, right alias)``.

    Blocks are equi-join keys, so the plan is a hash or sort-merge join with a residual predicate;
    adaptive execution splits a hot block.
    """
    names = [f"_b{i}" for i in range(len(block))]
    side = df.select("*", *[b.alias(n) for b, n in zip(block, names, strict=True)])
    left, right = side.alias("l"), side.alias("r")
    on = [F.col(f"l.{n}") == F.col(f"r.{n}") for n in names]
    cond = F.col(f"l.{key}") < F.col(f"r.{key}")
    for c in on:
        cond = cond & c
    return left.join(right, cond).where(within("l", "r")).select(F.col(f"l.{key}").alias("a"), F.col(f"r.{key}").alias("b")).distinct()


def hamming_bands(code: Column, radius: int, bits: int = 63) -> Column:
    """(band, value) keys so that codes within ``radius`` share one: pigeonhole over radius + 1 bands."""
    width = max(bits // (radius + 1), 1)
    bands = [(i, min(width, bits - i)) for i in range(0, bits, width)]
    if len(bands) > radius + 1:  # the last bands become one
        start = bands[radius][0]
        bands = bands[:radius] + [(start, bits - start)]
    return F.array(*[F.struct(F.lit(k).alias("band"), F.shiftright(code, i).bitwiseAND(F.lit(2**n - 1)).alias("value")) for k, (i, n) in enumerate(bands)])


def code_classes(df: DataFrame, key: str, block: str, code: str) -> DataFrame:
    """(block, code, rep, members): rows of one block with equal codes are one class, named by its smallest key; null codes are none."""
    return df.where(F.col(code).isNotNull()).groupBy(F.col(block).alias("block"), F.col(code).alias("code")).agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("members"))


def hamming_pairs(classes: DataFrame, radius: int, bits: int = 63) -> tuple[DataFrame, bool]:
    """(a, b, d, members_a, members_b) of classes of one block within ``radius``, and whether bands were used.

    Exact either way: codes within the radius agree in one of radius + 1 bands of bits, so an equi-join
    on (block, band, value) finds all of them; where bands are so narrow that they would join more
    rows than whole blocks do, blocks are joined. The counts that decide are measured.
    """
    kept = checkpointed(classes)
    banded = kept.withColumn("k", F.explode(hamming_bands(F.col("code"), radius, bits)))
    pairs = lambda df, by: df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0] or 0.0
    use_bands = pairs(banded, ["block", "k"]) < pairs(kept, ["block"])
    side, by = (banded, ["block", "k"]) if use_bands else (kept, ["block"])
    x, y = side.alias("x"), side.alias("y")
    on = F.col("x.rep") < F.col("y.rep")
    for c in by:
        on = on & (F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")))
    d = F.bit_count(F.col("x.code").bitwiseXOR(F.col("y.code")))
    found = x.join(y, on & (d <= radius)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), d.alias("d"), F.col("x.members").alias("members_a"), F.col("y.members").alias("members_b"))
    return (found.distinct() if use_bands else found), use_bands


def isolate(train: DataFrame, similar: DataFrame, key: str) -> DataFrame:
    """``train`` without the ids that stand on the left of ``similar``."""
    return train.join(similar.select(F.col("a").alias(key)).distinct(), key, "left_anti")


def representatives(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, component): the smallest id of each connected component; single nodes are their own."""
    comp = connected_components(edges, "a", "b")
    return nodes.select(key).join(comp.withColumnRenamed("node", key), key, "left").select(key, F.coalesce("component", key).alias("component"))


def cluster_summary(components: DataFrame) -> DataFrame:
    """Clusters, members, kept and removed rows, and the removal rate."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.when(F.col("n") > 1, 1)).alias("clusters"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).cast("long").alias("members"),
        F.count(F.lit(1)).alias("kept"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("removed"),
        F.round(F.coalesce(F.sum(F.col("n") - 1) / F.sum("n"), F.lit(0.0)), 6).alias("removal_rate"),
    )


def greedy_independent(df: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """``df`` with ``kept``: a row is kept unless a kept row with a smaller id is its neighbour.

    Rounds instead of a visit in order: a node without a smaller undecided neighbour is kept, its
    neighbours leave, and their other edges with them. Each round settles all local minima at once;
    only nodes that leave are collected, as a table.
    """
    left = checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    gone = None
    while not left.isEmpty():
        kept = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        lost = checkpointed(left.join(kept, "a", "left_semi").select(F.col("b").alias("lost")).distinct())
        gone = lost if gone is None else gone.union(lost)
        left = left.join(lost, left["a"] == lost["lost"], "left_anti").join(lost, left["b"] == lost["lost"], "left_anti")
        left = checkpointed(left)
    if gone is None:
        return df.withColumn("kept", F.lit(True))
    return df.join(gone.distinct(), df[key] == F.col("lost"), "left").withColumn("kept", F.col("lost").isNull()).drop("lost")
