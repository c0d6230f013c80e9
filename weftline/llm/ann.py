"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import checkpointed

#: Rows, and of these queries, that a fit reads at most, first in order of a hash of the id.
FIT_ROWS, FIT_QUERIES = 8000, 200
#: Queries searched at once: what the driver holds and sends to every task.
QUERY_BLOCK = 8192
SUBSTRING = 8
ROTATIONS = 15
#: Share of the fit's true neighbours that must lie within the Hamming radius.
TARGET = 0.97


class Index:
    """Centre, rotation and radius: codes are the signs of centred, rotated vectors."""

    def __init__(self, x: np.ndarray, k: int, target: float = TARGET):
        self.mean = x.mean(axis=0)
        y = x - self.mean
        rng = np.random.default_rng(5)
        rotation, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
        for _ in range(ROTATIONS):  # iterative quantisation: fit codes, then the rotation that fits them
            codes = np.where(y @ rotation > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(codes.T @ y)
            rotation = (u @ vt).T
        self.rotation = rotation
        self.bits = x.shape[1]
        q = x[:FIT_QUERIES]
        codes = self.encode(x)
        d = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T
        d[np.arange(len(q)), np.arange(len(q))] = np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            self.radius = self.bits
            return
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        h = POPCOUNT[codes[: len(q), None, :] ^ codes[near]].sum(axis=2)
        # neighbours in the sample lie no nearer than neighbours among all rows, so this errs upwards
        self.radius = int(np.quantile(h, target, method="higher"))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(rows, bits / 8) bytes: each byte is one substring of the code."""
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)


POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def reaches(radius: int, substrings: int) -> list[int]:
    """How far each substring is probed, -1 for not at all.

    If a code differs from the query by more than its reach in every substring, it differs by at
    least sum(reach + 1) = radius + 1 bits: so every code within the radius is met, and no smaller
    reaches would do.
    """
    return [(radius + 1) // substrings - 1 + (j < (radius + 1) % substrings) for j in range(substrings)]


def probe(queries: np.ndarray, codes: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(query, rows whose code lies within the radius, rows that were probed).

    Each substring has a table from its 256 values to rows. By the pigeonhole rule the union of the
    rows that are probed holds every code within the radius; whole codes decide. Probes are kept by
    substring and value.
    """
    tables = []
    for j, near in enumerate(reaches(radius, codes.shape[1])):
        order = np.argsort(codes[:, j], kind="stable")
        tables.append((near, order, np.searchsorted(codes[order, j], np.arange(257))))
    values = np.arange(256)
    probed: dict[tuple[int, int], np.ndarray] = {}
    for k, q in enumerate(queries):
        hit = np.zeros(len(codes), bool)
        for j, v in enumerate(q.tolist()):
            near, order, starts = tables[j]
            if near < 0:
                continue
            rows = probed.get((j, v))
            if rows is None:
                rows = np.concatenate([order[starts[s] : starts[s + 1]] for s in np.flatnonzero(POPCOUNT[values ^ v] <= near)])
                probed[j, v] = rows
            hit[rows] = True
        rows = np.flatnonzero(hit)
        yield k, rows[POPCOUNT[codes[rows] ^ q].sum(axis=1) <= radius], len(rows)


def nearest(rows: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows nearest to each row whose id is divisible by ``every``.

    Euclidean distance in double precision on the original vectors; ties go to the smaller id.
    Rotation and radius are fitted on a bounded sample of rows; every row is indexed, in the tables
    of its own batch, and meets the queries in blocks of QUERY_BLOCK, the only thing that is sent to
    all tasks; further blocks follow one after another, each with a checkpointed result. A task
    keeps k + 1 rows for each query, so the last shuffle holds as many for each query and task.
    A query with fewer than k rows inside the radius gets the rest by full comparison.

    Null ids, and vectors that are null, empty, zero or hold a null or non-finite component, take
    no part. Vectors are compared with those of their own length; each length has its own index.
    Each row is a query and a candidate for itself: a query is not its own candidate, but another
    row of the same id is, and rows that repeat an id or a vector each take a place. No rows: no rows.
    """
    spark = rows.sparkSession
    v = F.col(vector).cast("array<double>")
    good = F.col(vector).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    every_row = rows.where(F.col(id_col).isNotNull()).where(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    lengths = every_row.groupBy(F.size("v").alias("d")).agg(F.count_if(F.col("id") % every == 0).alias("n")).where("n > 0").orderBy("d").collect()
    parts = []
    for d, n in lengths:
        base = every_row if len(lengths) == 1 else every_row.where(F.size("v") == d)
        parts += _search(base.where(F.size("v") == d), k, every, target, -(-n // QUERY_BLOCK), d << 44)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    # the query's own row is one of those with its id at distance 0, which are all alike
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)
    found = found.withColumn("mine", F.min(F.when(own, F.col("n"))).over(Window.partitionBy("q")))
    rank = (F.col("n") - F.when(F.col("n") > F.col("mine"), 1).otherwise(0)).cast("int")
    return found.where(F.col("mine").isNull() | (F.col("n") != F.col("mine"))).select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _search(base: DataFrame, k: int, every: int, target: float, blocks: int, number: int) -> list[DataFrame]:
    """(q, query_id, vec_id, score) of the nearest k + 1 rows of each task, a DataFrame for each block of queries."""
    spark = base.sparkSession
    sample = np.array([r["v"] for r in base.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).collect()])
    # different vectors only: copies as neighbours would fit a radius of 0
    _, first = np.unique(sample, axis=0, return_index=True)
    index = Index(sample[np.sort(first)], k, target)
    queries, most = base.where(F.col("id") % every == 0), np.iinfo(np.int64).max

    def search(n: int) -> DataFrame:
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n)
        got = sorted((r["id"], r["v"]) for r in block.collect())
        shared = spark.sparkContext.broadcast((index, np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            idx, ids, q = shared.value
            if not len(ids):
                return
            q_codes = idx.encode(q)
            best_d, best_i = np.full((len(q), k + 1), np.inf), np.full((len(q), k + 1), most)
            far_d, far_i = best_d.copy(), best_i.copy()

            def keep(d: np.ndarray, i: np.ndarray, at: int, x: np.ndarray, own: np.ndarray) -> None:
                new = np.sqrt(((x - q[at]) ** 2).sum(axis=1))
                low = new <= d[at, -1]
                all_d, all_i = np.r_[d[at], new[low]], np.r_[i[at], own[low]]
                top = np.lexsort((all_i, all_d))[: k + 1]
                d[at], i[at] = all_d[top], all_i[top]

            for batch in batches:
                x, own = np.stack(batch["v"].to_list()), batch["id"].to_numpy()
                for a, cand, _ in probe(q_codes, idx.encode(x), idx.radius):
                    keep(best_d, best_i, a, x[cand], own[cand])
                    # few rows within the radius so far: those outside it too, so that k are found in the end
                    if not np.isfinite(best_d[a, -1]):
                        rest = np.ones(len(x), bool)
                        rest[cand] = False
                        keep(far_d, far_i, a, x[rest], own[rest])
            full = np.isfinite(best_d[:, -1])
            far_d[full] = np.inf
            for d, i in ((best_d, best_i), (far_d, far_i)):
                a, b = np.nonzero(np.isfinite(d))
                yield pd.DataFrame({"q": number + (n << 24) + a.astype(np.int64), "query_id": ids[a], "vec_id": i[a, b], "score": d[a, b]})

        return base.mapInPandas(run, "q long, query_id long, vec_id long, score double")

    return [search(n) if blocks == 1 else checkpointed(search(n)) for n in range(blocks)]


def op3_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
