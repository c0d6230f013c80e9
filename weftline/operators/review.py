"""Review results merged into splits in a fixed order, with a ledger of what each step took and left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.splits import hash_order, rank_in_group
from weftline.session import checkpointed

REMOVED = "removed"
#: Steps in the order in which they claim rows.
STEPS = ("duplicate", "rejected", "reviewed", "halved", "leakage", "conflict")


def by_state(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (key, split, state, origin, ...) with ``place`` and ``rule`` after the review states.

    Duplicates and rejected rows leave. Reviewed rows of the regular collection go to test; of every
    other collection one half, in hash order, goes to test and one to train. All else stays where it
    is, with a null rule. The first rule that fits a row claims it.
    """
    halves = rows.where((F.col("state") == "reviewed") & (F.col("origin") != "regular")).select(key, "origin", hash_order(key).alias("_h"))
    ranked = rank_in_group(halves, ["origin"], [F.col("_h"), F.col(key)], "_rk").select(F.col(key).alias("_k"), (F.col("_rk") % 2 == 1).alias("_odd"))
    j = rows.join(ranked, F.col(key) == F.col("_k"), "left")
    reviewed = F.col("state") == "reviewed"
    rule = F.when(F.col("state") == "duplicate", "duplicate").when(F.col("state") == "rejected", "rejected").when(reviewed & (F.col("origin") == "regular"), "reviewed").when(reviewed, "halved")
    place = F.when(F.col("rule").isin("duplicate", "rejected"), REMOVED).when(F.col("rule") == "reviewed", "test").when(F.col("rule") == "halved", F.when(F.col("_odd"), "test").otherwise("train")).otherwise(F.col("split"))
    return j.withColumn("rule", rule).withColumn("place", place).drop("_k", "_odd")


def claim(placed: DataFrame, key: str, keys: DataFrame, rule: str) -> DataFrame:
    """Rows whose key is in ``keys`` leave, claimed by ``rule``."""
    k = keys.select(F.col(key).alias("_k"), F.lit(True).alias("_hit")).distinct()
    j = placed.join(k, F.col(key) == F.col("_k"), "left")
    hit = F.col("_hit").isNotNull()
    return j.withColumn("rule", F.when(hit, rule).otherwise(F.col("rule"))).withColumn("place", F.when(hit, REMOVED).otherwise(F.col("place"))).drop("_k", "_hit")


def merge(rows: DataFrame, key: str, edges: DataFrame, content: Column) -> DataFrame:
    """(key, split, state, origin, place, rule): review states, then leakage, then conflicts.

    Leakage: a row in train that stands in ``edges`` (a, b) with one in test leaves train. Conflict: a
    row in test leaves if a row in train that reviewers put there has the same ``content``. Each step
    sees what the one before it left, so no pair of the edges crosses the splits at the end.
    """
    placed = checkpointed(by_state(rows.withColumn("_content", content), key))
    side = placed.select(F.col(key).alias("n"), "place")
    # both directions of an edge from one reading: to find the edges may be the dearest part
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
    test = side.where("place = 'test'").select(F.col("n").alias("b"))
    near_test = both.join(test, "b", "left_semi").select(F.col("a").alias(key))
    train = placed.where("place = 'train'").select(key)
    placed = checkpointed(claim(placed, key, train.join(near_test.distinct(), key, "left_semi"), "leakage"))
    reviewed_train = placed.where("place = 'train' and rule = 'halved'").select("_content").distinct()
    conflicts = placed.where("place = 'test'").select(key, "_content").join(reviewed_train, "_content", "left_semi").select(key)
    return claim(placed, key, conflicts, "conflict").select(key, "split", "state", "origin", "place", "rule")


def ledger(merged: DataFrame) -> DataFrame:
    """(step, rule, rows_in, claimed, removed, rows_out): what every step found, claimed and took away; counts follow from one to the next.

    A row is counted as claimed where it ended; what leakage and conflicts took had been placed before.
    """
    counts = merged.groupBy("rule").agg(F.count(F.lit(1)).alias("claimed"), F.count_if(F.col("place") == REMOVED).alias("removed"))
    total = merged.agg(F.count(F.lit(1)).alias("total"))
    steps = merged.sparkSession.createDataFrame(list(enumerate(STEPS, 1)), "step int, name string")
    rows = steps.join(counts, F.col("name") == F.col("rule"), "left").select("step", F.col("name").alias("rule"), F.coalesce("claimed", F.lit(0)).alias("claimed"), F.coalesce("removed", F.lit(0)).alias("removed"))
    before = rows.select(F.col("step").alias("_s"), F.col("removed").alias("_r"))
    gone = rows.join(F.broadcast(before), F.col("_s") <= F.col("step")).groupBy("step", "rule", "claimed", "removed").agg(F.sum("_r").alias("gone"))  # a row for each step
    return gone.join(F.broadcast(total)).select("step", "rule", (F.col("total") - F.col("gone") + F.col("removed")).alias("rows_in"), "claimed", "removed", (F.col("total") - F.col("gone")).alias("rows_out"))
