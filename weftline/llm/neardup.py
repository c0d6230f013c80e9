"""Embedding near-dedup: sorted projection passes with bounded neighbour windows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from weftline.operators.graph import connected_components
from weftline.session import checkpointed, with_prefix

BITS = 63
#: Rows that a block owns; each row meets every row up to WINDOW places behind it.
BLOCK, WINDOW = 1024, 512
#: Chance that two linked vectors meet in some pass.
TARGET = 0.9999
#: Blocks of a set that is compared in full: an eighth of it, within these bounds; similarities are made in strips.
LEAST_EXACT, MOST_EXACT, STRIP = 1024, 4096, 256


def bits_for(n: int, window: int = WINDOW) -> float:
    """First hashes that cut n evenly spread rows down to a window, and one more."""
    return max(0.0, math.log2(max(n, 1) / window)) + 1


def passes_for(n: int, cosine: float, target: float = TARGET, window: int = WINDOW) -> int:
    """Passes needed so that two vectors at the threshold share a cell with chance ``target``.

    Two vectors at angle a agree on a hash with chance 1 - a / pi. In a pass they share a cell if
    they agree on the first ``bits_for`` hashes. How many rows a cell holds plays no part in it.
    """
    p = (1 - math.acos(cosine) / math.pi) ** bits_for(n, window)
    return max(2, math.ceil(math.log(1 - target) / math.log(1 - p))) if p < 1 else 2


def hash_keys(x: np.ndarray, passes: int, seed: int = 11) -> np.ndarray:
    """(rows, passes) of 63 concatenated sign hashes each, the first hash on top."""
    keys = np.zeros((len(x), passes), np.int64)
    for p in range(passes):
        planes = np.random.default_rng([seed, p, x.shape[1]]).standard_normal((x.shape[1], BITS))
        bits = (x @ planes) > 0
        for b in range(BITS):
            keys[:, p] = keys[:, p] << 1 | bits[:, b]
    return keys


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: at most n - 1 of them."""
    root, out = list(range(n)), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(i), top(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def full_forest(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """What the pairs add to a spanning forest; ``root`` has the group of each row and is updated.

    As ``forest``, but a step for each row instead of each pair. ``i`` is sorted.
    """
    out = []
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else i
    for row, near in zip(i[starts].tolist(), np.split(j, starts[1:]), strict=False):
        own = root[row]
        groups, first = np.unique(root[near], return_index=True)
        out += [(row, int(near[f])) for g, f in zip(groups, first, strict=True) if g != own]
        if len(groups) > 1 or groups[0] != own:
            root[np.isin(root, np.r_[groups, own])] = min(groups[0], own)
    return out


def near_duplicates(rows: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", target: float = TARGET) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Equal vectors of a label are one class, which later steps see once with its number of rows.
    Classes are sorted in several passes, each by (label, length, 63 random sign hashes); in a pass
    a class is compared with the WINDOW classes behind it, in blocks of BLOCK rows cut from the
    global rank, so no run of like keys makes a task larger. The number of passes follows from the
    row count and ``target``. A pair is counted in the first pass in which both share a window or a
    cell (label, length and first hashes), so blocks emit one count for each row and a spanning
    forest, never the pairs themselves.
    Cells are measured. One that holds more than a window is compared in full, in pairs of blocks,
    so a link is met with chance ``target`` at least however dense the label is. Where the cells and
    windows of a label cost more than all its pairs, all its pairs are compared instead, once. That
    grows with the square of the cell (of the label); vectors that spread over cells never need it.

    Null ids: n_links as any row, but no part in naming components. Null labels, and vectors that
    are null, empty, zero or hold a null or non-finite component: no links. Different lengths do
    not link. Repeated rows link to each other. No rows: no rows.
    """
    # vectors travel in the precision in which they are stored, and are compared in double precision
    kind = "<f4" if isinstance(getattr(rows.schema[vector].dataType, "elementType", None), FloatType) else "<f8"
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    count = base.count()
    passes = passes_for(count, cosine, target)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            cls: list[bytes | None] = [None] * n
            keys: list[list[int] | None] = [None] * n
            raw: list[bytes | None] = [None] * n
            by_len: dict[int, list[int]] = {}
            vs = [None if v is None or g is None else np.asarray(v, float) for v, g in zip(batch["v"], batch["label"], strict=True)]
            for i, v in enumerate(vs):
                if v is not None and len(v) and np.isfinite(v).all() and v.any():
                    by_len.setdefault(len(v), []).append(i)
            for own in by_len.values():
                x = np.stack([vs[i] for i in own]) + 0.0
                for i, v, k in zip(own, x, hash_keys(x, passes).tolist(), strict=True):
                    cls[i], keys[i], raw[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest(), k, v.astype(kind).tobytes()
            yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "cls": cls, "keys": keys, "v": raw})

    every = checkpointed(base.mapInPandas(digest, "vec_id long, label string, cls binary, keys array<long>, v binary"))
    classes = every.where("cls is not null").groupBy("label", "cls").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"), F.first("keys").alias("keys"))
    classes = checkpointed(classes.withColumn("uid", F.monotonically_increasing_id()))
    prefix = int(bits_for(count))
    space = ["label", "dim"]
    classes = classes.withColumn("dim", F.length("v")).withColumn("cells", F.transform("keys", lambda k: F.shiftright(k, BITS - prefix)))
    large = classes.select(*space, F.posexplode("cells").alias("pass", "cell")).groupBy("pass", *space, "cell").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > WINDOW + 1)
    large = checkpointed(large)
    sizes = classes.groupBy(*space).agg(F.count(F.lit(1)).alias("c"))
    costs = large.groupBy(*space).agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("cost"))
    dense = sizes.join(costs, space).where(F.col("c").cast("double") * F.col("c") <= F.col("cost") + 2.0 * WINDOW * passes * F.col("c"))
    dense = checkpointed(dense.select(*space, "c"))
    rest = classes.join(dense.select(*space), space, "left_anti")
    long = rest.select("uid", "label", "dim", F.posexplode("keys").alias("pass", "key"))
    ranked = with_prefix(long, ["pass", "label", "dim", "key", "uid"], name="at")
    total = rest.count()
    ranks = ranked.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pass", (F.col("at") - F.col("pass") * total).cast("long").alias("r")))).alias("r"))
    ranks = ranks.select("uid", F.transform("r", lambda s: s["r"]).alias("ranks"))
    body = rest.select("uid", "label", "dim", "n", "v", "cells").join(ranks, "uid")
    spots = body.drop("dim").select("*", F.posexplode("ranks").alias("pass", "at")).withColumn("block", F.floor(F.col("at") / BLOCK))
    spots = spots.withColumn("block", F.explode(F.when((F.col("at") % BLOCK < WINDOW) & (F.col("block") > 0), F.array("block", F.col("block") - 1)).otherwise(F.array("block"))))

    def told(uid: np.ndarray, links: np.ndarray, edges: list[tuple[int, int]]) -> pd.DataFrame:
        some = np.flatnonzero(links)
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"uid": np.r_[uid[some], uid[e[:, 0]]], "links": pd.array([*links[some], *[None] * len(e)], "Int64"), "other": pd.array([*[None] * len(some), *uid[e[:, 1]]], "Int64")})

    def compare(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        p, block = int(key[0]), int(key[1])
        g = g.sort_values("at", ignore_index=True)
        labels, at, times = g["label"].to_numpy(), g["at"].to_numpy(), g["n"].to_numpy()
        ranks, cells = np.stack(g["ranks"].to_list()), np.stack(g["cells"].to_list())
        links, edges = np.zeros(len(g), np.int64), []
        sizes = g["v"].str.len().to_numpy()
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            x = np.frombuffer(b"".join(g["v"].iloc[own]), kind).astype(float).reshape(len(own), -1)
            x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            here = own[at[own] < (block + 1) * BLOCK]
            a, b = np.nonzero(x[: len(here)] @ x.T >= cosine)
            a, b = a[a < b], b[a < b]
            i, j = own[a], own[b]
            keep = (at[j] - at[i] <= WINDOW) & (labels[i] == labels[j])
            i, j = i[keep], j[keep]
            for q in range(p):
                fresh = (np.abs(ranks[i, q] - ranks[j, q]) > WINDOW) & (cells[i, q] != cells[j, q])
                i, j = i[fresh], j[fresh]
            links += np.bincount(i, times[j], len(g)).astype(np.int64) + np.bincount(j, times[i], len(g)).astype(np.int64)
            edges += forest(len(g), i, j)
        return told(g["uid"].to_numpy(), links, edges)

    # what is compared in full: all of a dense label (pass -1), and large cells of the others
    blocks = F.ceil(F.col("c") / F.least(F.greatest(F.col("c") / 8, F.lit(LEAST_EXACT)), F.lit(MOST_EXACT)))
    none = F.lit(None).cast("array<long>")
    full = classes.join(dense, space).select("uid", *space, "n", "v", none.alias("cells"), none.alias("ranks"), F.lit(-1).alias("pass"), F.lit(0).cast("long").alias("cell"), "c")
    in_cells = body.select("uid", *space, "n", "v", "cells", "ranks", F.posexplode("cells").alias("pass", "cell")).join(large, ["pass", *space, "cell"])
    full = full.unionByName(in_cells).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("uid", "pass"), F.col("blocks")))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    full = full.select("uid", *space, "n", "v", "cells", "ranks", "pass", "cell", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))

    def compare_full(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        p, a, b = int(key[0]), int(key[-2]), int(key[-1])
        g = g.sort_values(["block", "uid"], ignore_index=True)
        x = np.frombuffer(b"".join(g["v"]), kind).astype(float).reshape(len(g), -1)
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        times, first = g["n"].to_numpy(), int((g["block"] == a).sum())
        if p >= 0:
            ranks, cells = np.stack(g["ranks"].to_list()), np.stack(g["cells"].to_list())
        links, edges, root = np.zeros(len(g), np.int64), [], np.arange(len(g))
        for start in range(0, first, STRIP):
            left = start if a == b else first
            i, j = np.nonzero(x[start : min(start + STRIP, first)] @ x[left:].T >= cosine)
            i, j = i + start, j + left
            i, j = i[i < j], j[i < j]
            for q in range(p + 1):
                fresh = np.abs(ranks[i, q] - ranks[j, q]) > WINDOW
                if q < p:
                    fresh &= cells[i, q] != cells[j, q]
                i, j = i[fresh], j[fresh]
            links += np.bincount(i, times[j], len(g)).astype(np.int64) + np.bincount(j, times[i], len(g)).astype(np.int64)
            edges += full_forest(root, i, j)
        return told(g["uid"].to_numpy(), links, edges)

    out = "uid long, links long, other long"
    found = spots.groupBy("pass", "block").applyInPandas(compare, out)
    found = checkpointed(found.union(full.groupBy("pass", *space, "cell", "a", "b").applyInPandas(compare_full, out)))
    links = found.where("links is not null").groupBy("uid").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("other is not null").select("uid", "other"), "uid", "other")
    named = classes.select("uid", "label", "cls", "id", "n").join(links, "uid", "left").join(comp.withColumnRenamed("node", "uid"), "uid", "left")
    named = checkpointed(named.withColumn("component", F.coalesce("component", "uid")))
    # checkpointed, so that the join below is one of plain exchanges, whose hot components can be split
    first = checkpointed(named.groupBy("component").agg(F.min("id").alias("component_id")))
    named = named.join(first, "component").select(F.col("label").alias("c_label"), F.col("cls").alias("c_cls"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    # rows without a class are not hashed together on null
    whole = every.where("cls is not null").select("vec_id", "label", "cls").join(named, (F.col("label") == F.col("c_label")) & (F.col("cls") == F.col("c_cls")))
    alone = every.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = whole.select("vec_id", F.col("n_links").cast("long"), "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS to_ FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.to_),
c AS (SELECT node, min(to_) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
