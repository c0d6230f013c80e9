"""Streaming extensions: resumable ingestion, windows with late data, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of events; the zone-less time is read in the session's zone (UTC)."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "8")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        # a stream watches folders: this one, for the one file
        folder, name = path.rsplit("/", 1)
        stream = stream.option("pathGlobFilter", name).parquet(folder)
    else:
        stream = stream.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def first_per_bucket(events: DataFrame, seconds: int = 2) -> DataFrame:
    """The streaming form of one row per user and time bucket."""
    bucket = F.floor(F.col("ts").cast("double") / seconds)
    return events.withColumn("bucket", bucket).withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["user_id", "bucket"])


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; the checkpoint makes the next call resume."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def upsert_available(stream: DataFrame, merge, checkpoint: str, mode: str = "update") -> None:
    """The same through ``foreachBatch``: ``merge(batch, batch_id)`` must be idempotent."""
    stream.writeStream.outputMode(mode).foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
