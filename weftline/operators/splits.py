"""Quotas, samples and leakage-free splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.dedup import representatives
from weftline.session import checkpointed, with_prefix

SEED = "weftline"


def hash_order(*cols: str | Column, seed: str = SEED) -> Column:
    """A reproducible random order: md5 of seed and key, equal in every engine."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def fill(groups: DataFrame, group: str, total: int, weight: str = "weight", limit: str = "most") -> DataFrame:
    """(group, quota): whole numbers that share ``total`` by ``weight``, none above its ``limit`` (a whole number).

    Water-filling: what a full group cannot take goes to the others by weight, so the quotas add up
    to the total, or to all limits where those are less. Groups in order of limit / weight fill one
    after another; two prefix sums in that order tell which are full, and so the level of the rest.
    Shares are rounded by largest remainder (ties to the smaller group). Groups without weight get
    nothing. No task sees all groups.
    """
    rows = groups.where((F.col(weight) > 0) & (F.col(limit) > 0)).select(group, F.col(weight).cast("double").alias("w"), F.col(limit).cast("double").alias("m"))
    rows = rows.withColumn("_r", F.col("m") / F.col("w"))
    sums = rows.agg(F.sum("w").alias("w"), F.sum("m").alias("m")).first()
    share = float(min(total, sums["m"] or 0))
    run = with_prefix(with_prefix(rows, ["_r", group], F.col("m"), "_m"), ["_r", group], F.col("w"), "_w_before")
    run = checkpointed(run.withColumn("full", share - F.col("_m") >= F.col("_r") * (F.lit(sums["w"]) - F.col("_w_before"))))
    rest = run.where("not full").agg(F.sum("w").alias("w")).first()["w"]
    taken = run.where("full").agg(F.sum("m").alias("m")).first()["m"] or 0.0
    level = F.lit((share - taken) / rest if rest else 0.0)
    run = run.withColumn("share", F.when(F.col("full"), F.col("m")).otherwise(F.least("m", level * F.col("w"))))
    run = run.withColumn("base", F.floor(F.round("share", 9))).withColumn("_left", -F.round(F.col("share") - F.col("base"), 9))
    spare = share - (run.agg(F.sum("base")).first()[0] or 0)
    ranked = with_prefix(run.where("not full").select(group, "base", "_left"), ["_left", group], name="_at")
    open_ = ranked.select(group, (F.col("base") + F.when(F.col("_at") < spare, 1).otherwise(0)).cast("long").alias("quota"))
    return run.where("full").select(group, F.col("m").cast("long").alias("quota")).unionByName(open_)


def allocate(counts: DataFrame, group: str, total: int, big: int = 2, big_cap: int | None = None) -> DataFrame:
    """(group, n, quota): the ``big`` largest groups capped, the rest shared by the square root of their count.

    What small groups cannot take goes to the others: quotas add up to ``total``, or to all that caps and rows allow.
    """
    big_cap = total // 4 if big_cap is None else big_cap
    top = counts.orderBy(F.desc("n"), group).limit(big).select(F.col(group).alias("_g"), F.least("n", F.lit(big_cap)).cast("long").alias("_q"))
    marked = checkpointed(counts.join(F.broadcast(top), F.col(group).eqNullSafe(F.col("_g")), "left"))  # so many rows as ``big`` says
    taken = marked.agg(F.sum("_q")).first()[0] or 0
    rest = marked.where("_q is null").select(F.col(group).alias("_k"), F.sqrt("n").alias("weight"), F.col("n").alias("most"))
    filled = fill(rest, "_k", total - taken)
    out = marked.join(filled, F.col(group).eqNullSafe(F.col("_k")), "left")
    return out.select(group, "n", F.coalesce("_q", "quota", F.lit(0)).cast("long").alias("quota"))


def rank_in_group(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the rank from 1 of each row in its group: a distributed prefix sum, so no task sorts a whole group."""
    cols = [f"o_{i}" for i in range(len(order))]
    at = with_prefix(df.select("*", *[o.alias(c) for o, c in zip(order, cols, strict=True)]), [*group, *cols], name="o_at")
    start = at.groupBy(*group).agg(F.min("o_at").alias("o_start"))
    start = start.select(*[F.col(g).alias(f"s_{i}") for i, g in enumerate(group)], "o_start")
    on = [F.col(g).eqNullSafe(F.col(f"s_{i}")) for i, g in enumerate(group)]
    return at.join(start, on).select(*df.columns, (F.col("o_at") - F.col("o_start") + 1).cast("long").alias(name))


def take_quota(df: DataFrame, quotas: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Rows of each group in ``order`` up to its quota, without replacement."""
    ranked = rank_in_group(df, [group], order, "_rk")
    return ranked.join(quotas.select(group, "quota"), group).where(F.col("_rk") <= F.col("quota")).drop("_rk", "quota")


def grouped_split(groups: DataFrame, group: str, size: str = "n", share: float = 0.10) -> DataFrame:
    """(group, n, split): whole groups go to test in hash order while the running size stays within the share.

    A group larger than the share can never go and does not stop others, so the test side ends less
    than one group below the share. The running size is a distributed prefix sum: no task orders all groups.
    """
    rows = groups.select(group, size, hash_order(group).alias("_h"))
    total = rows.agg(F.sum(size)).first()[0] or 0
    fits = F.when(F.col(size) <= total * share, F.col(size)).otherwise(0)
    run = with_prefix(rows, ["_h", group], fits, "_before")
    test = (F.col(size) <= total * share) & (F.col("_before") + F.col(size) <= total * share)
    return run.select(group, size, F.when(test, F.lit("test")).otherwise(F.lit("train")).alias("split"))


def component_split(nodes: DataFrame, edges: DataFrame, key: str, size: Column | None = None, share: float = 0.10) -> DataFrame:
    """(key, group_id, members, n, split, reason): similar rows never stand on both sides.

    Components of ``edges`` (a, b) are the groups, rows without an edge groups of their own; ``size``
    is what a row counts for (1). Groups go by ``grouped_split``. The manifest tells for each row its
    group, how many rows and what size that has, and why it stands where it does: ``cluster`` or ``singleton``.
    """
    comp = representatives(nodes, edges, key).withColumnRenamed("component", "group_id")
    comp = checkpointed(comp.join(nodes.select(F.col(key).alias("_k"), (F.lit(1) if size is None else size).alias("_s")), F.col(key) == F.col("_k")).drop("_k"))
    groups = comp.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), F.sum("_s").alias("n"))
    split = grouped_split(groups.select("group_id", "n"), "group_id", "n", share)
    placed = groups.select(F.col("group_id").alias("_g"), "members").join(split, F.col("_g") == F.col("group_id")).drop("_g")
    reason = F.when(F.col("members") > 1, F.lit("cluster")).otherwise(F.lit("singleton"))
    return comp.select(key, "group_id").join(placed, "group_id").select(key, "group_id", "members", "n", "split", reason.alias("reason"))


def rarity(rows: DataFrame, key: str, values: str) -> DataFrame:
    """(key, rarity): the sum over a row's different values of 1 / rows that have the value; 0 without values.

    Frequencies are counted over all rows and checkpointed, so that the join takes plain exchanges and
    a value of very many rows can be split.
    """
    long = rows.select(key, F.explode(F.array_distinct(values)).alias("value")).where("value is not null")
    counts = checkpointed(long.groupBy("value").agg(F.count(F.lit(1)).alias("f")))
    scored = long.join(counts, "value").groupBy(F.col(key).alias("_k")).agg(F.round(F.sum(1 / F.col("f")), 9).alias("rarity"))
    return rows.select(key).join(scored, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("rarity", F.lit(0.0)).alias("rarity"))


def coverage_order(rows: DataFrame, key: str, values: str) -> DataFrame:
    """(key, gain) of the rows that greedy coverage takes: each the row with most values that no row before it has (ties: the smallest key), until all values are covered.

    Gains of the greedy order never rise, so sorting by gain and key gives that order, and its first k
    rows are the greedy choice of k. It is found in rounds without a visit in order: a row that beats
    every other row sharing an uncovered value with it cannot lose gain before its turn, so all such
    rows are taken at once, and their values leave. Maxima are partial aggregates; no value's rows
    meet in one task, and the lineage is cut in every round.
    """
    # of rows with the same values only that of the smallest key can ever gain
    sets = rows.groupBy(F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull()))).alias("values")).agg(F.min(key).alias("k"))
    left = checkpointed(sets.select("k", F.explode("values").alias("value")))
    taken = None
    while not left.isEmpty():
        gains = checkpointed(left.groupBy("k").agg(F.count(F.lit(1)).alias("gain")))
        rank = F.struct((-F.col("gain")).alias("g"), F.col("k").alias("k"))
        best = checkpointed(left.join(gains, "k").groupBy("value").agg(F.min(rank).alias("b")).select("value", F.col("b.k").alias("k")))
        wins = best.groupBy("k").agg(F.count(F.lit(1)).alias("won"))
        picked = checkpointed(gains.join(wins, "k").where("won = gain").select("k", "gain"))
        taken = picked if taken is None else taken.union(picked)
        covered = left.join(picked, "k", "left_semi").select("value")
        left = checkpointed(left.join(covered, "value", "left_anti"))
    if taken is None:
        return rows.select(key).where("false").withColumn("gain", F.lit(0).cast("long"))
    return taken.select(F.col("k").alias(key), "gain")


def diverse_subset(rows: DataFrame, key: str, values: str, k: int) -> DataFrame:
    """(key, gain, rarity, rk) of ``k`` rows: the greedy cover of all values first, then rows by rarity; ties by hash order."""
    cover = coverage_order(rows, key, values).withColumnRenamed(key, "_c")
    scored = rarity(rows, key, values).join(cover, F.col(key) == F.col("_c"), "left").select(key, F.coalesce("gain", F.lit(0)).cast("long").alias("gain"), "rarity")
    tie = F.when(F.col("gain") > 0, F.lit("")).otherwise(hash_order(key))
    last = F.when(F.col("gain") > 0, 0.0).otherwise(-F.col("rarity"))
    ranked = rank_in_group(scored.withColumn("_all", F.lit(1)), ["_all"], [-F.col("gain"), last, tie, F.col(key)], "rk")
    return ranked.where(F.col("rk") <= k).select(key, "gain", "rarity", "rk")


def leaks(edges: DataFrame, membership: DataFrame, key: str) -> DataFrame:
    """Edges whose ends stand in different splits; must be empty."""
    m = membership.select(key, "split")
    a = m.select(F.col(key).alias("a"), F.col("split").alias("split_a"))
    b = m.select(F.col(key).alias("b"), F.col("split").alias("split_b"))
    return edges.join(a, "a").join(b, "b").where("split_a <> split_b")
