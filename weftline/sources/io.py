"""Readers and writers: nested frames, manifests, CSV lists, fingerprints, reports, resumable runs."""

from __future__ import annotations

import html
import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.sources.manifest import read_manifest  # noqa: F401

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
FRAME_SCHEMA = f"frame_id string, scene string, regions array<struct<bbox:{BOX},crop_path:string,description:string,raw_text:string,status:string,error:string>>"
SPLIT_SCHEMA = "image string, annotation string, color_label string"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """One row per region of nested per-frame JSON; a frame without regions keeps one row with a null position."""
    frames = spark.read.schema(FRAME_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").option("recursiveFileLookup", "true").json(path)
    rows = frames.select("frame_id", "scene", F.posexplode_outer("regions").alias("pos", "region"))
    return rows.select("frame_id", "scene", "pos", F.when(F.col("pos").isNotNull(), F.concat_ws("#", F.concat_ws("/", "scene", "frame_id"), F.col("pos").cast("string"))).alias("sample_id"), "region.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", "true").csv(path)


def read_split_list(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Three columns: image, annotation and a label that may be missing."""
    return spark.read.schema(SPLIT_SCHEMA).option("sep", sep).csv(path)


def picture_size(data: bytes) -> tuple[int | None, int | None]:
    """(width, height) from the header of a PNG, JPEG, GIF, BMP or WebP file; nulls for anything else."""
    number = lambda at, n, order="big": int.from_bytes(data[at : at + n], order)
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return number(16, 4), number(20, 4)
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return number(6, 2, "little"), number(8, 2, "little")
    if data[:2] == b"BM" and len(data) >= 26:
        return number(18, 4, "little"), abs(int.from_bytes(data[22:26], "little", signed=True))
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X" and len(data) >= 30:
        return number(24, 3, "little") + 1, number(27, 3, "little") + 1
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data):
        if data[at] != 0xFF:
            at += 1
        elif data[at + 1] in (0x01, 0xFF, *range(0xD0, 0xDA)):  # markers without a length
            at += 1 if data[at + 1] == 0xFF else 2
        elif 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):  # a frame header
            return number(at + 7, 2), number(at + 5, 2)
        else:
            at += 2 + number(at + 2, 2)
    return None, None


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, width, height) from the headers of pictures; other files have null sizes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [picture_size(bytes(c)) for c in batch.pop("content")]
            batch["width"], batch["height"] = pd.array([w for w, _ in sizes], "Int32"), pd.array([h for _, h in sizes], "Int32")
            yield batch

    return files.mapInPandas(run, "path string, bytes long, width int, height int")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that appeared, went or differ; empty if a read-only source was left alone."""
    b, a = before.select("path", F.col("sha256").alias("before")), after.select("path", F.col("sha256").alias("after"))
    return b.join(a, "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def large_files(spark: SparkSession, path: str, least: int = 10_000_000) -> DataFrame:
    """Names of files of at least ``least`` bytes, from listing metadata only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") >= least).select("path", "length")


def write_immutable(df: DataFrame, path: str) -> DataFrame:
    """Write once as Parquet, beside it a digest table of the written rows; refuses to overwrite."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    written = df.sparkSession.read.parquet(f"{path}/data")
    digest = row_digest(written)
    digest.write.mode("errorifexists").json(f"{path}/sha256")
    return digest


def row_digest(df: DataFrame) -> DataFrame:
    """(n, digest): order-free digest of all rows, from the sum of 60-bit row hashes."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.coalesce(F.sum(row), F.lit(0)).cast("string"), 256).alias("digest"))


def snapshot(df: DataFrame, root: str, version: str) -> str:
    """A versioned folder that later corrections never touch."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_scored(df: DataFrame, path: str) -> None:
    """Per-sample scores, one folder per candidate, so that one candidate reads alone."""
    df.write.mode("errorifexists").partitionBy("candidate").parquet(path)


def run_summary(df: DataFrame, status: str = "status") -> DataFrame:
    """selected, processed, skipped, failed in one aggregate."""
    s = F.col(status)
    return df.agg(F.count(F.lit(1)).alias("selected"), F.count_if(s == "ok").alias("processed"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "failed").alias("failed"))


def summary_json(df: DataFrame) -> str:
    return json.dumps(df.first().asDict(), sort_keys=True)


def html_report(df: DataFrame, title: str, limit: int = 200) -> str:
    """A small table as a page: a report shows at most ``limit`` rows."""
    rows = df.limit(limit).collect()
    cells = lambda values, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
    return f"<!DOCTYPE html><title>{html.escape(title)}</title><table>{cells(df.columns, 'th')}{''.join(cells(r, 'td') for r in rows)}</table>"


def markdown_report(df: DataFrame, limit: int = 200) -> str:
    line = lambda values: "| " + " | ".join(str(v).replace("|", "\\|") for v in values) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(r) for r in df.limit(limit).collect()]])


# -- runs --------------------------------------------------------------------------------------


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: what has no result yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def shard(df: DataFrame, key: str, n: int) -> DataFrame:
    """Adds ``shard``, the same for equal keys in every run."""
    return df.withColumn("shard", F.pmod(F.crc32(F.col(key).cast("string")), F.lit(n)).cast("int"))


def round_robin(df: DataFrame, order: str, n: int) -> DataFrame:
    """Adds ``idx`` in ``order`` and ``worker`` = idx modulo n; ordering by idx restores the input."""
    from weftline.session import with_prefix

    ranked = with_prefix(df, [order], name="_at").withColumn("idx", F.col("_at").cast("long")).drop("_at")
    return ranked.withColumn("worker", (F.col("idx") % n).cast("int"))


def id_check(expected: DataFrame, merged: DataFrame, key: str) -> DataFrame:
    """Ids that are missing, unexpected or duplicated after a merge; empty if all is well."""
    e = expected.groupBy(key).agg(F.count(F.lit(1)).alias("want"))
    m = merged.groupBy(key).agg(F.count(F.lit(1)).alias("got"))
    both = e.join(m, key, "full_outer")
    problem = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("got") > F.col("want"), "duplicated")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def retry_failed(first: DataFrame, second: DataFrame, key: str, status: str = "status") -> DataFrame:
    """The complete set: rows that were fine, and for failed ones the second pass."""
    again = second.join(first.where(F.col(status) == "failed").select(key), key, "left_semi")
    return first.where(F.col(status) != "failed").unionByName(again)


def cached(requests: DataFrame, cache: DataFrame, key: Column, compute) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache entries): distinct keys meet the cache once; only misses are computed."""
    asked = requests.withColumn("cache_key", key)
    distinct = asked.dropDuplicates(["cache_key"])
    misses = compute(distinct.join(cache.select("cache_key"), "cache_key", "left_anti")).select("cache_key", "value")
    answers = asked.join(cache.select("cache_key", "value").unionByName(misses), "cache_key", "left")
    return answers, misses


def paired(truth: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Both sides of every key with ``state``: paired, no_prediction or no_truth; complete if all are paired."""
    t = truth.withColumn("_t", F.lit(True))
    p = predictions.withColumnRenamed(key, "_k").withColumn("_p", F.lit(True))
    j = t.join(p, F.col(key).eqNullSafe(F.col("_k")), "full_outer")
    state = F.when(F.col("_t").isNull(), "no_truth").when(F.col("_p").isNull(), "no_prediction").otherwise("paired")
    return j.withColumn("state", state).withColumn(key, F.when(F.col("_t"), F.col(key)).otherwise(F.col("_k"))).drop("_t", "_p", "_k")


def limits(regions: DataFrame, frame: str, order: list[Column], most_frames: int, most_regions: int) -> DataFrame:
    """At most ``most_regions`` rows of each frame, first in ``order``, of the ``most_frames`` smallest frame ids."""
    frames = regions.select(frame).distinct().orderBy(frame).limit(most_frames)
    some = regions.join(F.broadcast(frames), frame, "left_semi")  # bounded by the parameter
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(frame).orderBy(*order))).where(F.col("_n") <= most_regions).drop("_n")


def bounded_rows(df: DataFrame) -> Iterator:
    """All rows in order on the driver, which holds two partitions at most, whatever the size of the table."""
    return df.toLocalIterator(prefetchPartitions=True)


def call_service(df: DataFrame, client, schema: str, workers: int = 16, timeout: float = 60.0, retries: int = 2, wait: float = 1.0, failed=None) -> DataFrame:
    """Rows through a pluggable client in at most ``workers`` tasks at once, one batch each at a time.

    ``client`` maps a batch (pandas) to a batch of ``schema``. A call that takes longer than
    ``timeout`` seconds or raises is repeated ``retries`` times, after ``wait`` seconds that double
    each time. A batch that still fails goes to ``failed`` (batch, error), whose answer stands in its
    place; without ``failed`` the error ends the run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield answer(batch)

    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        for attempt in range(retries + 1):
            pool = ThreadPoolExecutor(1)
            try:
                return pool.submit(client, batch.copy()).result(timeout)
            except Exception as error:
                if attempt == retries and failed is not None:
                    return failed(batch, error)
                if attempt == retries:
                    raise
                time.sleep(wait * 2**attempt)
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
        raise AssertionError("unreachable")

    return df.repartition(workers).mapInPandas(run, schema)
