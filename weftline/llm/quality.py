"""Quality classifier: Naive Bayes support vectors (log-count ratios, hinge loss, dual descent)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import carried, text_parts


#: Labelled documents of each class that a fit reads at most, whole, in order of a hash of the id.
SAMPLE_PER_CLASS = 2500
#: Indicators live in 2^BITS hashed columns.
BITS = 18
ALPHA, COST, EPOCHS = 1.0, 1.0, 12
THRESHOLD = 0.7
TOKENS = re.compile(r"[^\W\d_]+|\d+|\n+|[^\w\s]+|_+")
MEMO = 1_000_000


class _Codes(dict):
    """token -> lexical hash (20 bits) with its shape above; computed once per token, of ``most`` tokens."""

    most = MEMO

    def __missing__(self, token: str) -> int:
        first = token[0]
        if first.isalpha():
            shape = 1 if token.islower() else 2 if token.istitle() else 3 if token.isupper() else 4
        elif first.isdigit():
            shape = 5
        elif first == "\n":
            shape = 6
        else:
            shape = 8 + zlib.crc32(token[:3].encode()) % 240
        code = (zlib.crc32(token.lower().encode()) & 0xFFFFF) | shape << 20
        if len(self) < self.most:
            self[token] = code
        return code


def features(text: str, codes: _Codes) -> np.ndarray:
    """Distinct hashed indicators: word uni- and bigrams, shape uni- to trigrams, binned shares."""
    tokens = TOKENS.findall(text)
    n = len(tokens)
    code = np.fromiter(map(codes.__getitem__, tokens), np.int64, n)
    word, shape = code & 0xFFFFF, code >> 20
    mask = (1 << BITS) - 1

    def mixed(x: np.ndarray, salt: int) -> np.ndarray:
        return ((x * np.int64(0x5851F42D4C957F2D) + np.int64(salt * 0x14057B7EF767 % (1 << 62))) >> 40) & mask

    grams = [mixed(word, 1), mixed(word[:-1] << 20 | word[1:], 2), mixed(shape, 3), mixed(shape[:-1] << 8 | shape[1:], 4), mixed(shape[:-2] << 16 | shape[1:-1] << 8 | shape[2:], 5)]
    kinds = np.bincount(np.minimum(shape, 8), minlength=9)
    shares = np.floor(10 * kinds / max(n, 1)).astype(np.int64) + 11 * np.arange(9)
    distinct = int(10 * len(np.unique(word)) / max(n, 1))
    grams.append(mixed(np.r_[shares, 200 + distinct, 220 + min(n, 1 << 20).bit_length()], 6))
    return np.unique(np.concatenate(grams)).astype(np.int32)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [np.full(1 << BITS, ALPHA) for _ in range(2)]
    for x, positive in zip(rows, y > 0, strict=True):
        counts[int(positive)][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights on r-scaled unit-length indicators by dual coordinate descent for the hinge loss."""
    values = [r[x] for x in rows]
    values = [v / max(float(np.sqrt(v @ v + 1)), 1e-12) for v in values]
    ones = np.array([1 / max(float(np.sqrt(r[x] @ r[x] + 1)), 1e-12) for x in rows])
    cost = np.where(y > 0, COST * len(y) / max(2 * (y > 0).sum(), 1), COST * len(y) / max(2 * (y < 0).sum(), 1))
    w, b, a = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            g = y[i] * (w[x] @ v + b * ones[i]) - 1
            new = min(max(a[i] - g, 0.0), cost[i])  # scaled rows have length 1
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[x] += step * v
                b += step * ones[i]
                a[i] = new
    return w, b


class Model:
    """A linear score on r-scaled indicators and its logistic calibration."""

    def __init__(self, r: np.ndarray, w: np.ndarray, b: float, slope: float = 1.0, shift: float = 0.0):
        self.r, self.w = r.astype(np.float32), w.astype(np.float32)
        self.b, self.slope, self.shift = b, slope, shift
        self.codes = _Codes()

    def __getstate__(self):
        codes = _Codes()
        codes.most = self.codes.most
        return self.__dict__ | {"codes": codes}

    def margin(self, x: np.ndarray) -> float:
        v = self.r[x].astype(float)
        return float((self.w[x] @ v + self.b) / np.sqrt(v @ v + 1))

    def score(self, text: str | None) -> float:
        m = self.margin(features(text or "", self.codes))
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -30, 30))))


def calibrate(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift by Newton steps, with his smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.c_[m, np.ones_like(m)]
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p))
        c += step
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0]), float(c[1])


def train(rows: list[np.ndarray], y: np.ndarray) -> Model | None:
    """Fit on all rows; the calibration uses margins of two halves that did not see each other."""
    if not (y > 0).any() or not (y < 0).any():
        return None
    half, margins = np.arange(len(y)) % 2, np.zeros(len(y))
    for k in (0, 1):
        own = [i for i in range(len(y)) if half[i] == k]
        if len(set(y[own])) < 2:
            own = list(range(len(y)))
        part = [rows[i] for i in own]
        r = log_count_ratio(part, y[own])
        m = Model(r, *dual_descent(part, y[own], r))
        for i in np.flatnonzero(half != k):
            margins[i] = m.margin(rows[i])
    r = log_count_ratio(rows, y)
    return Model(r, *dual_descent(rows, y, r), *calibrate(margins, y))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model | None:
    """Learn from the labelled rows among ``docs`` (doc_id, text); None if a class has no row.

    Bounded: of each class at most ``per_class`` documents, the first in order of a hash of the id,
    whole. Their indicators are made by the executors; the driver gets integers, never texts.
    An id with contradicting labels counts as the worse one, labels of null ids and null labels not
    at all; of an id with several rows one is read. Null texts are empty ones.
    """
    spark = docs.sparkSession
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = one.where("q = 1").orderBy(*order).limit(per_class).union(one.where("q = 0").orderBy(*order).limit(per_class))
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("q").cast("int").alias("q"))
    # of an id with several rows one is read, the smallest by hash, then text: the driver gets a row for each chosen id
    texts = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("_id")).select("_id", "q", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.groupBy("_id", "q").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("_id", "q", "t.h", "t.text")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _Codes()
        for batch in batches:
            x = [features(t, codes) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["_id"], "q": batch["q"], "h": batch["h"], "x": [v.tobytes() for v in x]})

    got = texts.mapInPandas(extract, "id long, q int, h long, x binary").toPandas()
    got = got.sort_values(["h", "id"], kind="stable")
    rows = [np.frombuffer(x, np.int32) for x in got["x"]]
    return train(rows, np.where(got["q"].to_numpy(int) == 1, 1.0, -1.0))


def score(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns, score and predicted (1 if score >= THRESHOLD).

    Whole texts, one pass, no shuffle; strings and results leave slice by slice. Null and empty texts are scored as texts without a token.
    Without a model (no labelled row of one class) every score is 1: nothing is rejected unseen.
    Repeated rows: equal scores. No rows: no rows. A kept column named like a result comes back with
    ``_in`` behind its name; a kept text is sent once.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    there, back = carried(keep, ["score", "predicted"])
    rows = docs.select(*there) if "text" in keep else docs.select(*there, docs["text"].alias("t"))
    text = f"k_{keep.index('text')}" if "text" in keep else "t"
    schema = rows.drop("t").schema.add("score", "double").add("predicted", "integer")

    names = [c for c in rows.columns if c != "t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in text_parts(batch, text):
                s = np.array([1.0 if m is None else m.score(t) for t in part.column(text).to_pylist()], float)
                yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    return rows.mapInArrow(run, schema).select(*back, "score", "predicted")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
