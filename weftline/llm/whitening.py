"""Whitening of vectors by matrix-free block subspace iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from weftline.llm.blocks import blocked, grid, matrix, unpack, usable
from weftline.session import carried, checkpointed

#: Entries of this size and more have no place on the grid of longs.
LARGEST = 2**46
#: Directions that a pass takes along besides the wanted ones, and blocks that a basis holds before it is pressed.
SPARE, BLOCKS = 8, 6
#: A component is certified when its residual is at most this share of the largest eigenvalue.
TOLERANCE = 1e-12
MOST_PASSES = 500
#: Directions of less than this share of the largest variance are rounding and no components.
LEAST = 1e-12


def exact_sum(x: np.ndarray) -> list[int]:
    """Column sums without overflow."""
    if not len(x):
        return [0] * x.shape[1]
    wide = max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= 2**62
    return [int(s) for s in (x.astype(object) if wide else x).sum(axis=0)]


class Centre:
    """The exact mean S / n of integer vectors."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.shift = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = [s - n * (s // n) for s in sums]

    def numerator(self, x: np.ndarray) -> np.ndarray:
        """n * x - S: longs where they fit, else Python's integers."""
        gap = x - self.shift
        if self.n * (max(abs(int(gap.min(initial=0))), abs(int(gap.max(initial=0)))) + 1) < 2**62:
            return gap * self.n - np.array(self.rest, dtype=np.int64)
        return gap.astype(object) * self.n - np.array(self.rest, dtype=object)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """x - S / n as doubles, rounded once."""
        return (self.numerator(x) / self.n).astype(float)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum of (n * x - S)^2, exact; None where a long cannot hold it."""
        gap = self.numerator(x)
        if gap.dtype != object and gap.shape[1] * max(abs(int(gap.min(initial=0))), abs(int(gap.max(initial=0)))) ** 2 < 2**63:
            return (gap * gap).sum(axis=1).tolist()
        gap = gap.astype(object)
        return [v if v < 2**63 else None for v in (gap * gap).sum(axis=1).tolist()]


def _summed(blocks: DataFrame, dims: int, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` (a matrix of ``width`` columns) over all blocks: one matrix a task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("x"):
                more = part(unpack(data.as_py(), dims))
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    rows = blocks.select("x").mapInArrow(run, "i int, v array<double>")
    summed = rows.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v"))
    return np.array([r["v"] for r in sorted(summed.collect(), key=lambda r: r["i"])])


def _count_and_sums(blocks: DataFrame, dims: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dims
        for batch in batches:
            for data in batch.column("x"):
                x = unpack(data.as_py(), dims)
                n, total = n + len(x), [a + b for a, b in zip(total, exact_sum(x), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([str(v) for v in [n, *total]])], ["i", "v"])

    rows = blocks.select("x").mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    got = {r["i"]: int(r["v"]) for r in rows.collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(dims)]


def subspace(product: Callable[[np.ndarray], np.ndarray], dims: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` largest eigenvalues and unit eigenvectors of a symmetric matrix that only ``product`` knows; and the passes.

    A pass gives the product with one orthonormal block (QR). Rayleigh-Ritz over the blocks so far
    gives vectors and their residuals; the residuals, made orthogonal, are the next block, so the
    space widens towards what is not settled. A basis of BLOCKS blocks is pressed to its leading
    vectors. When all k residuals are small the vectors go through one more pass of their own, and
    only residuals measured there certify them.
    """
    width = min(k + SPARE, dims)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((dims, width)))[0]
    basis, image, alone = np.empty((dims, 0)), np.empty((dims, 0)), False
    for passes in range(1, MOST_PASSES + 1):
        basis, image = np.hstack([basis, q]), np.hstack([image, product(q)])
        small = basis.T @ image
        values, z = np.linalg.eigh((small + small.T) / 2)
        values, z = values[::-1], z[:, ::-1]
        ritz, moved = basis @ z, image @ z
        residual = moved - ritz * values
        if np.linalg.norm(residual[:, :k], axis=0).max() <= TOLERANCE * max(values[0], 0.0):
            if alone:
                return values[:k], ritz[:, :k], passes
            q = np.linalg.qr(ritz[:, :width])[0]
            basis, image, alone = np.empty((dims, 0)), np.empty((dims, 0)), True
            continue
        alone = False
        if basis.shape[1] >= dims:  # nothing is left to add but the vectors themselves
            q = np.linalg.qr(ritz[:, :width])[0]
            basis, image, alone = np.empty((dims, 0)), np.empty((dims, 0)), True
            continue
        if basis.shape[1] + width > BLOCKS * width:
            basis, image = ritz[:, : 2 * width], moved[:, : 2 * width]
        q = residual[:, : min(width, dims - basis.shape[1])]
        for _ in range(3):  # once more for columns that are mostly rounding
            q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
    raise RuntimeError(f"residuals are not small after {MOST_PASSES} passes")


def whiten(vectors: DataFrame, keep: list[str], k: int = 16, scale: int = 64, offset: int = 1_000_000, vector: str = "embedding") -> DataFrame:
    """``keep`` columns, ``n``, ``deviation``, ``whitened`` and ``explained`` (arrays by component), ``identity_error``.

    Entries become floor(``scale`` * entry) + ``offset``. The fit list has each distinct vector once:
    n vectors with exact sums S. Components are the unit eigenvectors of their covariance (divisor n)
    by falling eigenvalue, at most ``k``; the largest entry of each is positive. The fit list is
    checkpointed in packed blocks; a pass multiplies centred rows with one block of directions, and
    only dims * (k + SPARE) sums a task leave it. Nothing but such matrices reaches the driver.

    Left out: vectors that are null or empty, hold null or non-finite entries or some of LARGEST and
    more, and vectors of another length than the most frequent one (ties: the longer). Directions
    without variance are no components: equal vectors alone give rows with empty arrays. Copies count
    once in the fit and get a row each. ``deviation`` is null where no long can hold it. No rows: no
    rows. A kept column named like a result comes back with ``_in`` behind its name.
    """
    results = ["n", "deviation", "whitened", "explained", "identity_error"]
    there, back = carried(keep, results)
    v = F.col(f"`{vector}`")
    good = vectors.where(usable(v, LARGEST / scale)).select(*there, v.alias("v"))
    longest = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dims = longest[0]["d"] if longest else 1
    rows = good.where(F.size("v") == dims).select(*[c for c in good.columns if c != "v"], F.transform(grid(F.col("v"), scale), lambda c: c + offset).alias("x"))
    fit = checkpointed(blocked(rows.select("x").distinct()))
    n, sums = _count_and_sums(fit, dims) if longest else (0, [])
    if not n:
        schema = rows.drop("x").schema.add("n", "long").add("deviation", "long").add("whitened", ArrayType(DoubleType())).add("explained", ArrayType(DoubleType())).add("identity_error", "double")
        return vectors.sparkSession.createDataFrame([], schema).select(*back, *results)
    centre = Centre(n, sums)

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = centre.apply(x)
            return y.T @ (y @ q)

        return _summed(fit, dims, q.shape[1], part) / n

    values, axes, _ = subspace(product, dims, min(k, dims))
    real = values > LEAST * values[0] if values[0] > 0 else values > 0
    values, axes = values[real], axes[:, real]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    found = len(values)
    weights = axes / np.sqrt(values)

    def check(x: np.ndarray) -> np.ndarray:
        """Products of whitened rows, their sums, and the sum of all squares: rows of one matrix."""
        y = centre.apply(x)
        w = y @ weights
        last = np.zeros((1, max(found, 1)))
        last[0, 0] = (y * y).sum()
        return np.vstack([w.T @ w, w.sum(axis=0, keepdims=True), last]) if found else last

    measured = _summed(fit, dims, max(found, 1), check) / n
    trace = float(measured[-1, 0])
    mean = measured[found : found + 1] if found else measured[:0]
    error = float(np.abs(measured[:found] - mean.T @ mean - np.eye(found)).max(initial=0.0)) if found else 0.0

    kept = [f for f in rows.schema.fields if f.name != "x"]
    schema = rows.drop("x").schema.add("deviation", "long").add("whitened", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            w = centre.apply(x) @ weights
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * found, pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(centre.deviation(x), pa.int64()), lists], [*(f.name for f in kept), "deviation", "whitened"])

    explained = F.array(*[F.lit(float(e) / trace) for e in values]).cast("array<double>")
    return rows.mapInArrow(run, schema).select(*back, F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    out = whiten(vectors, ["vec_id"])
    each = out.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("i") + 1).alias("explained"), "identity_error")
