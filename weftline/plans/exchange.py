"""Sources and sinks by way of files: what is written to the shared folder is read again (SRC-1, 4, 5, 8, 9, SNK-2, 5)."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.base import query
from weftline.session import checkpointed, remove_folder, shared_folder
from weftline.sources import io


def through_files(t, work) -> DataFrame:
    """The rows that ``work`` (a folder of its own) gives; they are kept, and the folder goes."""
    folder = f"{shared_folder(t.spark).rstrip('/')}/exchange-{uuid.uuid4().hex}"
    out = checkpointed(work(folder))
    remove_folder(t.spark, folder)
    return out


@query("src_1_frames", """WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
SELECT conv_id::VARCHAR AS frame_id, 's' || conv_id % 7 AS scene, pos::INT AS pos, 's' || conv_id % 7 || '/' || conv_id || '#' || pos AS sample_id, md5(text) AS description, CASE WHEN turn % 5 = 4 THEN 'failed' ELSE 'ok' END AS status, turn * 10.0::DOUBLE AS x1, length(text)::DOUBLE AS x2 FROM c
UNION ALL SELECT 'empty', 's0', NULL, NULL, NULL, NULL, NULL, NULL""")
def _(t):
    """Conversations as nested frames, written as JSON files of many frames; one frame has no regions."""
    turn = F.col("turn")
    box = F.struct((turn * 10.0).alias("x1"), F.lit(0.0).alias("y1"), F.length("text").cast("double").alias("x2"), F.lit(1.0).alias("y2"))
    region = F.struct("turn", box.alias("bbox"), F.lit("crop.jpg").alias("crop_path"), F.md5("text").alias("description"), F.when(turn % 5 == 4, "failed").otherwise("ok").alias("status"))
    frames = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(region)).alias("regions"))
    frame = F.struct(F.col("conv_id").cast("string").alias("frame_id"), F.concat(F.lit("s"), F.col("conv_id") % 7).alias("scene"), F.transform("regions", lambda r: r.dropFields("turn")).alias("regions"))
    # a file holds one array of at most 500 frames, however many there are
    files = frames.groupBy(F.floor(F.col("conv_id") / 500).alias("part")).agg(F.to_json(F.collect_list(frame)).alias("value"))
    empty = t.spark.createDataFrame([(-1, '[{"frame_id": "empty", "scene": "s0", "regions": []}]')], "part long, value string")

    def work(folder: str) -> DataFrame:
        files.unionByName(empty).write.partitionBy("part").text(folder)
        rows = io.read_frames(t.spark, folder)
        return rows.select("frame_id", "scene", "pos", "sample_id", "description", "status", "bbox.x1", "bbox.x2")

    return through_files(t, work)


@query("src_4_csv", "SELECT l_orderkey AS image, count(*) AS gt_px, round(sum(l_quantity), 6) AS pred_px, max(l_returnflag) || ', \"' || max(l_linestatus) || '\"' AS note FROM lineitem GROUP BY 1")
def _(t):
    """Per-image rows as CSV with a header, with commas and quotes in a text."""
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("image")).agg(F.count(F.lit(1)).alias("gt_px"), F.round(F.sum("l_quantity"), 6).alias("pred_px"), F.concat(F.max("l_returnflag"), F.lit(', "'), F.max("l_linestatus"), F.lit('"')).alias("note"))

    def work(folder: str) -> DataFrame:
        io.write_csv(g, folder)
        return io.read_csv(t.spark, folder, "image long, gt_px long, pred_px double, note string")

    return through_files(t, work)


@query("src_5_split_list", "SELECT 'img/' || p_partkey || '.jpg' AS image, 'ann/' || p_partkey || '.json' AS annotation, CASE WHEN p_size % 3 <> 0 THEN split_part(p_name, ' ', 1) END AS color_label FROM part")
def _(t):
    """Lists of three columns, of which the last is often missing."""
    key = F.col("p_partkey").cast("string")
    line = F.concat(F.lit("img/"), key, F.lit(".jpg ann/"), key, F.lit(".json"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(1)))).otherwise(""))

    def work(folder: str) -> DataFrame:
        t.part.select(line.alias("value")).write.text(folder)
        return io.read_split_list(t.spark, folder)

    return through_files(t, work)


@query("src_8_service", "SELECT p_partkey, CASE WHEN p_size = 13 THEN 'failed' ELSE 'a ' || p_type || ' ' || p_name END AS answer FROM part")
def _(t):
    """A service as a function of batches, behind timeout and retry; what it refuses is answered as failed."""

    def client(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["p_size"] == 13).any():
            raise ValueError("refused")
        return pd.DataFrame({"p_partkey": batch["p_partkey"], "answer": "a " + batch["p_type"] + " " + batch["p_name"]})

    def failed(batch: pd.DataFrame, error: Exception) -> pd.DataFrame:
        # what is refused stands in the rows, so the others go once more as one batch: no refusal costs another row its answer
        refused = batch["p_size"] == 13
        return pd.concat([client(batch[~refused]), pd.DataFrame({"p_partkey": batch.loc[refused, "p_partkey"], "answer": "failed"})])

    rows = t.part.select("p_partkey", "p_name", "p_type", "p_size")
    return io.call_service(rows, client, "p_partkey long, answer string", workers=4, retries=0, failed=failed)


@query("src_9_fingerprints", "SELECT n_regionkey, n_regionkey = 2 AS changed FROM nation GROUP BY 1")
def _(t):
    """Files of nations by region, fingerprinted; then one is written anew."""

    def work(folder: str) -> DataFrame:
        rows = t.nation.select("n_regionkey", F.concat_ws("|", "n_nationkey", "n_name").alias("value"))
        put = lambda df, where: df.coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(f"{folder}/{where}")
        keys = [r[0] for r in rows.select("n_regionkey").distinct().collect()]
        for k in keys:
            put(rows.where(F.col("n_regionkey") == k).select("value"), f"region={k}")
        of = lambda: io.fingerprints(t.spark, folder).where("path like '%/part-%'").select(F.regexp_extract("path", "region=([0-9]+)", 1).alias("path"), "sha256")
        before = checkpointed(of())
        for k in keys:
            put(rows.where(F.col("n_regionkey") == k).select(F.concat("value", F.lit("!" if k == 2 else "")).alias("value")), f"region={k}")
        after = checkpointed(of())
        return before.join(io.changed(before, after).select(F.col("path").alias("_p")), F.col("path") == F.col("_p"), "left").select(F.col("path").cast("int").alias("n_regionkey"), F.col("_p").isNotNull().alias("changed"))

    return through_files(t, work)


@query("snk_2_report", """WITH g AS (SELECT r_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1) SELECT 1 AS line, '| r_name | nations |' AS text UNION ALL SELECT 2, '| --- | --- |'
UNION ALL SELECT 2 + row_number() OVER (ORDER BY r_name), '| ' || r_name || ' | ' || nations || ' |' FROM g""")
def _(t):
    """A Markdown table of an aggregate, a line a row: the report is small whatever the tables are."""
    g = t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("nations")).orderBy("r_name")
    return t.spark.createDataFrame(list(enumerate(io.markdown_report(g).split("\n"), 1)), "line long, text string")


@query("snk_5_snapshot", "SELECT o_orderkey, o_orderstatus AS before, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS after FROM orders")
def _(t):
    """Results before and after a correction, each in its own version of the folder."""

    def work(folder: str) -> DataFrame:
        first = t.spark.read.parquet(io.snapshot(t.orders.select("o_orderkey", "o_orderstatus"), folder, "1"))
        fixed = first.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")))
        second = t.spark.read.parquet(io.snapshot(fixed, folder, "2"))
        return first.withColumnRenamed("o_orderstatus", "before").join(second.withColumnRenamed("o_orderstatus", "after"), "o_orderkey")

    return through_files(t, work)
