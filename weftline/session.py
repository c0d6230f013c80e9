"""Session settings and the few run-time helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def build_session(app: str = "weftline", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WEFTLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder, through Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share.

    Where it is unset, a local session gets a temporary folder of this machine; a cluster an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="weftline-")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete what a run has left in a folder of its own, on whatever store holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def in_parts(texts: list[str | None], chars: int = 4_000_000) -> Iterator[slice]:
    """Slices of a batch (which Spark bounds in bytes) of so many characters, for work that holds more than its texts."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > chars:
            yield slice(start, i)
            start, held = i, 0
        held += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))


def text_parts(batch: pa.RecordBatch, text: str, size: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch whose texts have so many bytes, or of one row: a task holds the strings and results of one slice."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        held = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, held + size, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def carried(keep: list[str], results: list[str]) -> tuple[list[Column], list[Column]]:
    """Columns that pass through a function under names that clash with nothing, and the way back.

    A kept column that has the name of a result comes back with ``_in`` behind its name.
    """
    there = [F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep)]
    back = [F.col(f"k_{i}").alias(f"{c}_in" if c in results else c) for i, c in enumerate(keep)]
    return there, back


def with_prefix(df: DataFrame, order: list[str], weight: Column | None = None, name: str = "prefix") -> DataFrame:
    """Add the exclusive running sum of ``weight`` (1 for a rank) in the global order of ``order``.

    ``order`` must be a total order up to identical rows. Rows are range-partitioned, sorted and
    checkpointed, so no task sees more than its range; a row's place in its partition is its rank
    there. A weighted sum is a window over each such partition, so pass narrow rows. Only one total
    for each partition reaches the driver, and goes back as a join with so many rows.
    """
    spark = df.sparkSession
    rows = df.withColumn("_w", (F.lit(1) if weight is None else weight).cast("double"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = checkpointed(rows.repartitionByRange(n, *order).sortWithinPartitions(*order))
    rows = rows.withColumns({"_p": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))})
    totals = {r[0]: r[1] for r in rows.groupBy("_p").agg(F.sum("_w")).collect()}
    start, offsets = 0.0, [(-1, 0.0)]  # one more than there are, so never without a row
    for p in sorted(totals):
        offsets.append((p, start))
        start += totals[p]
    # a row for each partition; from Arrow, as a list of rows would start Python workers of another kind in every executor
    offsets = pa.table({"_o": pa.array([o[0] for o in offsets], pa.int32()), "_before": pa.array([o[1] for o in offsets], pa.float64())})
    before = F.broadcast(spark.createDataFrame(offsets))
    if weight is None:
        within = F.col("_at").cast("double")
    else:
        w = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        within = F.coalesce(F.sum("_w").over(w), F.lit(0.0))
    placed = rows.withColumn("_in", within).join(before, F.col("_p") == F.col("_o"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_in")).alias(name))
