"""The corpus pipeline: quality, near duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and returns
a DataFrame that is written as Parquet and read again as the next stage's ``docs``. Columns of
``docs`` may have any name beside doc_id, text and source. Rows that repeat are decided alike. No
rows give no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, mixing, quality, secrets, shingles
from weftline.session import remove_folder, shared_folder


#: Tokens that a task of a stage remembers: workers of all stages live side by side with one long-running session.
MEMO = 100_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, as they are.

    Null and empty texts are scored as texts without a token; null ids are scored but never learned
    from. Without labels of both classes nothing is rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs.select("doc_id", "text"), labels.where(~quality.held_out(F.col("doc_id"))))
    if model is not None:
        model.codes.most = MEMO
    names = docs.columns
    rest = [c for c in names if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), "text")
    good = quality.score(rows, model, ["row", "text"]).where("predicted = 1")
    return good.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Null and wordless texts are groups of their own; of rows equal in id and text one stays;
    unlinked texts that share an id, or have none, all stay.
    """
    return shingles.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; base spans and live-looking tokens are replaced by a mark. Null and empty texts stay."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; every copy is a row.

    Null texts have no words: they come as often as their source has whole epochs, as do empty ones.
    A null source is a source of its own. Equal rows of one id share their copies.
    """
    names = docs.columns
    weights = mixing.quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    weights = weights.select(F.col("doc_id").alias("w_id"), F.col("weight").alias("w"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", F.xxhash64("text").alias("hash"), F.col("text").alias("words"))
    narrow = rows.select("doc_id", "source", mixing.word_count(F.col("words")).alias("n_words"), F.col("hash").alias("text"))
    narrow = narrow.join(weights, F.col("doc_id") == F.col("w_id"), "left")
    # the text waits; the mix decides on ids and hashes, equal rows of one id together
    taken = mixing.mix(narrow, F.col("n_words"), F.coalesce("w", F.lit(0.5)), keep=["doc_id", "source", "text"])
    taken = taken.where("copies > 0").groupBy("doc_id", "source", "text").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    taken = taken.select(F.col("doc_id").alias("t_id"), F.col("source").alias("t_source"), F.col("text").alias("t_hash"), "copies", "n")
    rows = rows.select("row", "doc_id", "source", "hash")
    rows = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("t_id")) & F.col("source").eqNullSafe(F.col("t_source")) & (F.col("hash") == F.col("t_hash")))
    once = rows.where("n = 1")
    if not taken.where("n > 1").isEmpty():  # equal rows: one of them carries the copies of all
        once = once.unionByName(rows.where("n > 1").dropDuplicates(["t_id", "t_source", "hash"]))
    copies = once.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*[F.col("row").getField(c).alias(c) for c in names])


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with their digests; null and empty texts have none."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id", "source"], with_ids=True, memo=MEMO)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("byte-level bpe", tokens_stage),
]

#: SQL can express neither the trained classifier nor the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between stages go to the shared checkpoint folder, and leave it but for the last.

    An empty table passes through every stage; null texts as each stage says.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # nothing reads the stage before this one any more
            remove_folder(spark, f"{folder}/{k - 1}")
    return docs
