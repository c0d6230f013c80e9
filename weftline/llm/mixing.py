"""Mixing sources to target weights (Efraimidis-Spirakis sampling), in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import carried, checkpointed, with_prefix

#: Slices of the key range in each source, at least, and rows for each further one. Only the slice
#: that holds the cut is sorted.
LEAST_SLICES, SLICE_ROWS = 4096, 20_000
#: Keys beyond this share the last slice.
LARGEST_KEY = 1e13
#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"
#: The first half of the slices is equal for rows of this weight; the other is even in log(key), for very small weights.
TYPICAL_WEIGHT = 0.5


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def quality_weights(labels: DataFrame, good: float = 1.0, bad: float = 0.25) -> DataFrame:
    """(doc_id, weight) of the labelled rows; contradicting labels count as the worse one."""
    return (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("q"))
        .select("doc_id", F.when(F.col("q") == 1, F.lit(good)).otherwise(F.lit(bad)).alias("weight"))
    )


def source_targets(totals: DataFrame, budget: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, source_size) -> the same with ``target``.

    Weights are dealt in code point order of the sources, null last. Water-filling: with the
    sources in order of cap * size / weight, a source is full exactly if its own limit is below
    the level that all later sources would share, so prefix sums find the level in one pass.
    Sources are ordered in one task: a row of two numbers for each. A null source is one of them.
    Empty sources: target 0. Equal ratios: in the order of the sources. No rows: no rows.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    deal = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    t = totals.select("source", "source_size", deal.alias("w"), (F.lit(cap) * F.col("source_size")).alias("most"))
    t = t.withColumn("ratio", F.col("most") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    t = t.select(
        "*",
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("full"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("rest"),
        (F.lit(budget) * F.sum("source_size").over(every)).alias("budget"),
    )
    t = t.withColumn("level", (F.col("budget") - F.col("full")) / F.col("rest"))
    # the level of the first source, in this order, that does not fill up
    t = t.withColumn("open", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(every))
    target = F.when(F.col("open").isNull() | (F.col("ratio") < F.col("open.ratio")), F.col("most")).otherwise(F.least(F.col("most"), F.col("w") * F.col("open.level")))
    return t.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column, weight: Column, budget: float = 1.5, cap: float = 2.0, seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """How often each row is taken: ``docs`` columns named in ``keep``, then size, source_size, target, copies, taken.

    Keys are exponential with the row's weight as rate, from a hash of ``doc_id`` (so reruns agree);
    small keys come first. A source's target first pays whole epochs; what is left selects rows in
    key order until their prefix sum reaches it, the row at the cut if that comes nearer.
    Keys are cut into slices by their uniform rank. Sums per slice decide all slices but the one at
    the cut, so only that slice of each source is sorted, whatever a source's share of all rows; it is
    sorted over all tasks by a distributed prefix sum, so rows that share an id, or have none, may be many.

    Null text or no words: size 0, nothing taken, and as many copies as whole epochs. Null source: a
    source of its own, last. Null doc_id: one more id. Weights that are null or not positive count as
    a very small rate. Repeated rows each count; ties of keys are broken by id, size and text hash.
    Columns of ``docs`` may have any name; a kept one named like a result comes back with ``_in``
    behind its name. No rows: no rows.
    """
    keep = keep or ["doc_id"]
    results = ["size", "source_size", "target", "copies", "taken"]
    there, back = carried(keep, results)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(1.0)) / F.lit(float(2**48 + 1))
    rate = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(1e-9))
    rows = docs.select(*there, F.col("doc_id").alias("_id"), F.col("source").alias("source"), size.alias("size"), (-F.log(u) / rate).alias("key"), F.xxhash64("text").alias("_tie"))
    rows = checkpointed(rows)  # narrow: the texts are read and counted once, whatever follows
    slice_count = max(LEAST_SLICES, rows.count() // SLICE_ROWS)
    spread = (F.lit(1.0) - F.exp(-F.col("key") * TYPICAL_WEIGHT) + F.least(F.log1p("key") / math.log1p(LARGEST_KEY), F.lit(1.0))) / 2
    rows = rows.withColumn("slice", F.floor(spread * slice_count).cast("long"))
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("s_size"))
    totals = slices.groupBy("source").agg(F.sum("s_size").alias("source_size"))
    targets = source_targets(totals, budget, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("epochs", epochs.cast("long")).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("s_size").over(before), F.lit(0)))
    plan = slices.join(targets, slices["source"].eqNullSafe(targets["source"])).select(
        slices["source"].alias("p_source"), slices["slice"].alias("p_slice"), "before", "s_size", "source_size", "target", "epochs", "left",
        (F.col("before") + F.col("s_size") <= F.col("left")).alias("all_in"), (F.col("before") >= F.col("left")).alias("none_in"),
    )
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("slice") == F.col("p_slice")))
    sure = dealt.where("all_in or none_in").withColumn("extra", F.when(F.col("all_in") & (F.col("size") > 0), 1).otherwise(0))
    order = ["key", "_id", "size", "_tie"]
    cut = with_prefix(dealt.where("not all_in and not none_in").withColumn("_none", F.col("source").isNull()), ["_none", "source", *order], F.col("size"), "_upto")
    start = cut.groupBy(F.col("source").alias("c_source")).agg(F.min("_upto").alias("_from"))
    cut = cut.join(start, F.col("source").eqNullSafe(F.col("c_source"))).withColumn("at", F.col("before") + F.col("_upto") - F.col("_from")).drop("_none", "_upto", "_from", "c_source")
    cut = cut.withColumn("extra", F.when((F.col("at") + F.col("size") / 2 <= F.col("left")) & (F.col("size") > 0), 1).otherwise(0)).drop("at")
    out = sure.unionByName(cut).withColumn("copies", (F.col("epochs") + F.col("extra")).cast("long"))
    return out.select(*back, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed to the targets; quality labels weigh the keys, unlabelled rows in between."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    w = quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    # sizes first: the text itself never reaches a shuffle
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("n_words"), F.xxhash64("text").alias("text"))
    rows = narrow.join(w, "doc_id", "left")
    return mix(rows, F.col("n_words"), F.coalesce(F.col("weight"), F.lit(0.5))).drop("copies")


OP1_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN min(quality) = 1 THEN 1.0 ELSE 0.25 END AS weight FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
d AS (SELECT d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        -ln((('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE + 1.0) / 281474976710657.0) / coalesce(weight, 0.5)::DOUBLE AS key
      FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
t AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS most FROM s),
f AS (SELECT *, most / w AS ratio,
        coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
        sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS budget FROM t),
g AS (SELECT *, (budget - full_) / rest AS level FROM f),
o AS (SELECT min_by(level, ratio) AS level, min(ratio) AS ratio FROM g WHERE g.ratio > g.level),
targets AS (SELECT g.source, g.source_size, CASE WHEN o.ratio IS NULL OR g.ratio < o.ratio THEN g.most ELSE least(g.most, g.w * o.level) END AS target FROM g LEFT JOIN o ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS left_,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_
      FROM d JOIN e ON e.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN pos_ < left_ AND pos_ + size / 2.0 <= left_ THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""
