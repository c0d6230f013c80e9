"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.neardup import full_forest
from weftline.operators.graph import connected_components
from weftline.session import checkpointed, text_parts, with_prefix

WORD = re.compile(r"\w+")
N = 5
SIMILARITY = 0.8
#: Chance that a pair at the similarity shares a band.
RECALL = 0.9995
MOST_HASHES = 200
#: What a block of documents holds: as many documents, or as many shingles, at most.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 400_000
#: Ids that are sent to all tasks instead of shuffling the texts.
MOST_SENT = 2_000_000
#: Words that a task remembers with their hashes.
MEMO = 100_000


def choose_bands(similarity: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the longest rows whose bands reach the recall within ``most`` hashes."""
    best = (1, 1)
    for r in range(1, 13):
        p = similarity**r
        b = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if b * r <= most:
            best = (b, r)
    return best


class _Words(dict):
    def __missing__(self, w: str) -> int:
        h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        if len(self) < MEMO:
            self[w] = h
        return h


def shingle_set(text: str | None, words: _Words, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of lower-case words; a shorter text is one gram."""
    found = WORD.findall((text or "").lower())
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    k = max(len(h) - n + 1, 1)
    g = np.full(k, len(h[:n]), np.uint64)
    for i in range(min(n, len(h))):
        g = (g ^ h[i : i + k]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    return np.unique(g)


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.x = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)[:, None]
        self.m = (rng.integers(0, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1))[:, None]

    def band_hashes(self, s: np.ndarray) -> np.ndarray:
        low = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 2048):
            low = np.minimum(low, ((s[None, i : i + 2048] ^ self.x) * self.m).min(axis=1))
        out = np.zeros(self.bands, np.uint64)
        for v in low.reshape(self.bands, self.rows).T:
            out = (out ^ v) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return out.view(np.int64)


def jaccard_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which candidate pairs reach the similarity, on the full sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    ok = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j])
    out = np.zeros(len(i), bool)
    i, j, at = i[ok], j[ok], np.flatnonzero(ok)
    used = np.unique(np.r_[i, j])
    if not len(used):
        return out
    shared = np.zeros(len(i), np.int64)
    values = np.concatenate([sets[k] for k in used])
    owner = np.repeat(np.arange(len(used)), sizes[used])
    order = np.argsort(values, kind="stable")
    first = np.r_[True, values[order][1:] != values[order][:-1]]
    column = np.cumsum(first) - 1
    df = np.bincount(column)
    wide = np.flatnonzero(df >= 2)
    if len(i) * 20 < len(used) * max(len(wide), 1) / 100 + 1000:
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    else:  # dense candidates: incidence matrices over stretches of the shared grams
        new = np.full(len(df), -1, np.int64)
        new[wide] = np.arange(len(wide))
        col, own = new[column], owner[order]
        row_of = np.full(len(sets), -1, np.int64)
        row_of[used] = np.arange(len(used))
        total = np.zeros((len(used), len(used)), np.float32)
        bounds = np.searchsorted(column, np.r_[wide, len(df)])
        del values, column
        for a in range(0, len(wide), 4096):
            b = min(a + 4096, len(wide))
            part = slice(bounds[a], bounds[b])
            m = np.zeros((len(used), b - a), np.float32)
            c = col[part]
            hit = c >= 0
            m[own[part][hit], c[hit] - a] = 1
            total += m @ m.T
        shared = total[row_of[i], row_of[j]].astype(np.int64)
    out[at] = shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9
    return out


def join(docs: DataFrame, similarity: float = SIMILARITY, n: int = N, recall: float = RECALL) -> DataFrame:
    """One row per input row: doc_id, text_hash, component, class_id, copy_id, n_links, kept.

    ``copy_id`` is the smallest id with the same n-gram set. ``n_links`` counts the other rows whose
    Jaccard similarity reaches the threshold, copies included; ``class_id`` is the smallest id that
    links reach; ``kept`` is doc_id = class_id. ``component`` tells groups of linked rows apart, also
    where ids repeat or are null; it is null for a wordless text.

    Steps: (1) one pass over whole texts makes the set's digest and its band hashes; equal sets
    become one document with a count before anything is joined. (2) Band hashes shuffle; only
    documents that share a band with another go on. Their bands give a star per bucket, never its
    pairs, and connected components order them so that likely partners stand together. (3) That
    order is cut into blocks bounded in documents and shingles; a pair of blocks meets only if a
    bucket spans both, and then verifies every pair that shares a band on the full sets. A pair
    is seen in one block pair only. Blocks emit counts and a spanning forest, so a group of like
    texts costs comparisons but never rows, and no task holds more than two blocks. As links are
    counted, a group of m different like texts costs m squared comparisons, and its sets meet in
    (m / BLOCK_DOCS) squared block pairs. The full sets are made anew from the texts of step 2's
    documents.

    Fewer than n words: one gram of all words. Null, empty and wordless texts: no links, a class of
    their own. Null ids never name a class unless all members are null. Repeated rows link to each
    other. No rows: no rows.
    """
    bands, width = choose_bands(similarity, recall)
    hasher = MinHash(bands, width)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.col("text").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for part in text_parts(batch, "text"):
                cls, sig, size = [], [], []
                for t in part.column("text").to_pylist():
                    s = shingle_set(t, words, n)
                    size.append(len(s))
                    cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sig.append(hasher.band_hashes(s) if len(s) else None)
                done = [pa.array(cls, pa.binary()), pa.array(size, pa.int64()), pa.array(sig, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), *done], ["doc_id", "text_hash", "cls", "size", "bands"])

    every = checkpointed(rows.mapInArrow(sign, "doc_id long, text_hash long, cls binary, size long, bands array<long>"))
    classes = every.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("times"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = checkpointed(classes.withColumn("uid", F.monotonically_increasing_id()))
    spots = classes.select("uid", F.posexplode("bands").alias("band", "h"))
    # checkpointed, so that the join below is one of plain exchanges, whose hot buckets can be split
    buckets = checkpointed(spots.groupBy("band", "h").agg(F.min("uid").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    member = checkpointed(spots.join(buckets.drop("c"), ["band", "h"]).select("uid", "band", "h", "head"))
    likely = connected_components(member.select("uid", "head").distinct(), "uid", "head").withColumnRenamed("component", "near")
    active = classes.join(likely, classes["uid"] == likely["node"]).select("uid", "near", "cls", "id", "times", "size", "bands")
    active = active.withColumn("first", F.element_at("bands", 1))
    weight = F.lit(1.0 / BLOCK_DOCS) + F.col("size") / F.lit(float(BLOCK_SHINGLES))
    placed = with_prefix(active.select("uid", "near", "first", "size"), ["near", "first", "uid"], weight, "at")
    placed = checkpointed(placed.select("uid", F.floor("at").cast("long").alias("block")))
    spread = member.select("uid", "band", "h").join(placed, "uid").select("band", "h", "block").distinct()
    left, right = spread.withColumnRenamed("block", "a"), spread.withColumnRenamed("block", "b")
    cross = left.join(right, ["band", "h"]).where("a < b").select("a", "b").distinct()
    pairs = placed.select(F.col("block").alias("a"), F.col("block").alias("b")).distinct().union(cross)

    # the full sets, from the texts of the active classes' first rows
    wanted = active.select(F.col("cls").alias("w_cls"), F.col("id").alias("w_id"), F.col("uid").alias("w_uid"))
    sent = active.select(F.col("id").alias("w_id")).distinct()
    if sent.count() <= MOST_SENT:
        sent = F.broadcast(sent)
    texts = rows.join(sent, rows["doc_id"].eqNullSafe(F.col("w_id")), "left_semi").select("text")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            for part in text_parts(batch, "text"):
                s = [shingle_set(t, words, n).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in s], pa.binary()), pa.array(s, pa.binary())], ["cls", "grams"])

    grams = texts.mapInArrow(expand, "cls binary, grams binary").join(wanted, F.col("cls") == F.col("w_cls")).groupBy(F.col("w_uid").alias("uid")).agg(F.first("grams").alias("grams"))
    ready = placed.join(grams, "uid").join(active.select("uid", "times", "bands"), "uid")
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))

    def verify(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        a, b = int(key[0]), int(key[1])
        g = g.sort_values("uid", ignore_index=True)
        block, times, uid = g["block"].to_numpy(), g["times"].to_numpy(), g["uid"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in g["grams"]]
        sig = np.stack(g["bands"].to_list())
        same = np.zeros((len(g), len(g)), bool)
        for k in range(sig.shape[1]):
            same |= sig[:, k][:, None] == sig[:, k][None, :]
        i, j = np.nonzero(np.triu(same, 1))
        mine = block[i] != block[j] if a != b else np.ones(len(i), bool)
        i, j = i[mine], j[mine]
        ok = jaccard_pairs(sets, i, j, similarity)
        i, j = i[ok], j[ok]
        links = (np.bincount(i, times[j], len(g)) + np.bincount(j, times[i], len(g))).astype(np.int64)
        some = np.flatnonzero(links)
        e = np.array(full_forest(np.arange(len(g)), i, j), np.int64).reshape(-1, 2)
        return pd.DataFrame({"uid": np.r_[uid[some], uid[e[:, 0]]], "links": pd.array([*links[some], *[None] * len(e)], "Int64"), "other": pd.array([*[None] * len(some), *uid[e[:, 1]]], "Int64")})

    found = checkpointed(ends.join(ready, "block").groupBy("a", "b").applyInPandas(verify, "uid long, links long, other long"))
    links = found.where("links is not null").groupBy("uid").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("other is not null").select("uid", "other"), "uid", "other")
    named = classes.select("uid", "cls", "id", "times").join(links, "uid", "left").join(comp.withColumnRenamed("node", "uid"), "uid", "left").withColumn("component", F.coalesce("component", "uid"))
    named = checkpointed(named)
    # checkpointed, so that the join below is one of plain exchanges, whose hot components can be split
    first = checkpointed(named.groupBy("component").agg(F.min("id").alias("class_id")))
    named = named.join(first, "component").select(F.col("cls").alias("c_cls"), F.col("id").alias("copy_id"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class_id", "component")
    whole = every.where("cls is not null").select("doc_id", "text_hash", "cls").join(named, F.col("cls") == F.col("c_cls"))
    whole = whole.select("doc_id", "text_hash", "component", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.col("n_links").cast("long"))
    alone = every.where("cls is null").select("doc_id", "text_hash", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return whole.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text_hash", "component")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: one whose id names the class.

    Rows that leave are matched by id. Ids that occur more than once, null among them, are settled by
    (id, text hash): of the rows of one component that hold the kept id, the smallest hash stays, so
    unlinked texts that share an id all stay, and ties go to the smallest id, then hash. Null and
    wordless texts are components of their own. Rows equal in id and text leave one. Columns may have
    any name. No rows: no rows.
    """
    got = checkpointed(join(docs.select("doc_id", "text")))
    ids = got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.max("kept").alias("k"))
    gone = checkpointed(ids.where("c > 1 or not k").select(F.col("doc_id").alias("g_id"), (F.col("c") > 1).alias("many")))
    sent = F.broadcast if gone.count() <= MOST_SENT else lambda d: d
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("h"), F.col("text").isNull().alias("n"))
    simple = rows.join(sent(gone), rows["id"].eqNullSafe(gone["g_id"]), "left_anti").select("row")
    many = gone.where("many")
    if not many.isEmpty():
        kept = got.join(sent(many), got["doc_id"].eqNullSafe(F.col("g_id")), "left_semi").where("kept")
        kept = kept.groupBy(F.col("doc_id").alias("r_id"), "component", F.when(F.col("component").isNull(), F.col("text_hash"))).agg(F.min("text_hash").alias("r_hash"))
        one = kept.select("r_id", "r_hash").distinct()
        again = rows.join(one, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("h") == F.col("r_hash")), "left_semi")
        simple = simple.union(again.dropDuplicates(["id", "h", "n"]).select("row"))
    return simple.select("row.*")
