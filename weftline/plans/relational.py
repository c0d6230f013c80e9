"""Relational cover beyond the survey's operators, marked as extensions: star joins, cubes, windows, streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.plans.base import query
from weftline.session import shared_folder
from weftline.streaming import windows


@query("ext_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2")
def _(t):
    li = t.lineitem.where(F.col("l_shipdate") <= F.to_timestamp_ntz(F.lit("2000-09-02 00:00:00")))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count(F.lit(1)).alias("n"))


@query("ext_star_join", """SELECT r_name, year(o_orderdate)::INT AS y, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
JOIN part ON p_partkey = l_partkey WHERE p_type = 'PROMO' GROUP BY 1, 2""")
def _(t):
    c = F.col
    li = t.lineitem.join(t.part.where("p_type = 'PROMO'"), c("l_partkey") == c("p_partkey"))
    j = li.join(t.orders, c("l_orderkey") == c("o_orderkey")).join(t.customer, c("o_custkey") == c("c_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey")).join(t.region, c("n_regionkey") == c("r_regionkey"))
    return j.groupBy("r_name", F.year("o_orderdate").alias("y")).agg(F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"))


@query("ext_cube", "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "qty")


@query("ext_window_frames", "SELECT event_id, round(avg(value) OVER w, 6) AS moving, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), value), 6) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.round(F.avg("value").over(w.rowsBetween(-2, 0)), 6).alias("moving"), F.round(F.col("value") - F.coalesce(F.lag("value").over(w), F.col("value")), 6).alias("step"))


@query("ext_sessions", "SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR, true))::INT AS new FROM events)) GROUP BY 1, 2")
def _(t):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    sec = F.col("ts").cast("timestamp").cast("double")
    e = t.events.withColumn("new", F.coalesce((sec - F.lag(sec).over(w) > 6 * 3600), F.lit(True)).cast("int"))
    return e.withColumn("session", F.sum("new").over(w)).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query("ext_asof_join", "SELECT o_orderkey, event_id FROM (SELECT o.event_id AS o_orderkey, e.event_id AS event_id, row_number() OVER (PARTITION BY o.event_id ORDER BY e.ts DESC, e.event_id DESC) AS n FROM events o JOIN events e ON e.user_id = o.user_id AND e.event_type = 'view' AND e.ts <= o.ts WHERE o.event_type = 'purchase') WHERE n = 1")
def _(t):
    """The last view before each purchase: one sort per user and a running last value, not a range join."""
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = t.events.where(F.col("event_type").isin("view", "purchase"))
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("v", last).where("event_type = 'purchase' and v is not null").select(F.col("event_id").alias("o_orderkey"), F.col("v").alias("event_id"))


@query("ext_stream_window_counts", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    """File stream to the end of its input, through a checkpointed query, then read back."""
    spark = t.spark
    folder = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}-{spark.range(1).select(F.expr('uuid()')).first()[0]}"
    stream = windows.window_counts(windows.read_events(spark, f"{t.sf_dir}/events.parquet"))
    flat = stream.select("event_type", F.col("window.start").cast("long").alias("start"), "n")
    # complete mode keeps the windows that the watermark has not closed
    rows = []
    windows.upsert_available(flat, lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out") or rows.append(1), f"{folder}/checkpoint", mode="complete")
    return spark.read.parquet(f"{folder}/out")
