"""Centroid clustering on integer grids by Exponion search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from weftline.llm.blocks import blocked, grid, unpack, usable
from weftline.session import carried, checkpointed

#: Distances are exact as longs for grid entries below this.
LARGEST = 2**27
#: Rounds between two cuts of the lineage.
ROUNDS_A_CUT = 8
#: Bounds are doubles; they are widened by this share, so that rounding never hides a tie.
UP, DOWN = 1 + 1e-12, 1 - 1e-12


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to one centroid (or row by row)."""
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


class Layout:
    """Centroids, the distances between them, and for each one the others from near to far."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        k = len(centroids)
        self.at = centroids
        self.gap = np.sqrt(np.array([squared(centroids, c) for c in centroids]).astype(float)).reshape(k, k)
        self.others = [[j for j in np.argsort(self.gap[a], kind="stable").tolist() if j != a] for a in range(k)]
        #: Distance to the nearest other centroid.
        self.nearest = np.array([self.gap[a, o[0]] if o else np.inf for a, o in enumerate(self.others)])
        moved = np.zeros(k) if before is None else np.sqrt(squared(centroids, before).astype(float)) * UP
        self.moved = moved
        #: How far any other centroid has moved at most.
        self.others_moved = np.array([max((moved[j] for j in o), default=0.0) for o in self.others])


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New owners and bounds, and how many distances were computed.

    ``upper`` bounds the distance to the own centroid, ``lower`` that to every other one; both are
    moved along with the centroids first. A vector whose upper bound is below its lower bound, or
    below half the way to the nearest other centroid, keeps its owner. Every other one scans only
    centroids within 2 * distance + the way to the nearest other of its own, from near to far: no
    nearer or second nearest one can lie outside. Comparisons of distances are exact; ties go to the
    smaller number.
    """
    own, upper = own.copy(), (upper + layout.moved[own]) * UP
    lower = lower * DOWN - layout.others_moved[own]
    enough = lambda rows: upper[rows] < np.maximum(lower[rows], layout.nearest[own[rows]] * (DOWN / 2))
    todo = np.flatnonzero(~enough(slice(None)))
    exact = squared(x[todo], layout.at[own[todo]])
    upper[todo] = np.sqrt(exact.astype(float)) * UP
    work = len(todo)
    open_ = ~enough(todo)
    todo, exact = todo[open_], exact[open_]
    reach = (2 * upper[todo] + layout.nearest[own[todo]]) * UP
    was = own[todo]
    for a in np.unique(was).tolist():
        mine = np.flatnonzero(was == a)
        rows, radius = todo[mine], reach[mine]
        best, owner = exact[mine], np.full(len(rows), a)
        second = np.full(len(rows), np.inf)
        xs = x[rows]
        for j in layout.others[a]:
            near = np.flatnonzero(radius >= layout.gap[a, j] * DOWN)
            if not len(near):
                break
            d = squared(xs[near], layout.at[j])
            work += len(near)
            wins = (d < best[near]) | ((d == best[near]) & (j < owner[near]))
            second[near] = np.minimum(second[near], np.where(wins, best[near], d))
            best[near], owner[near] = np.where(wins, d, best[near]), np.where(wins, j, owner[near])
        own[rows], upper[rows], lower[rows] = owner, np.sqrt(best.astype(float)) * UP, np.sqrt(second) * DOWN
    return own, upper, lower, work


def _pass(state: DataFrame, dims: int, layout: Layout) -> DataFrame:
    """One assignment of all blocks: their new state, and for each cluster rows, sums and distances."""
    k = len(layout.at)
    names = state.columns
    extra = {"sizes": pa.list_(pa.int64()), "sums": pa.list_(pa.int64()), "spread": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x = unpack(row.column("x")[0].as_py(), dims)
                numbers = [np.frombuffer(row.column(c)[0].as_py(), t) for c, t in (("own", "<i4"), ("upper", "<f8"), ("lower", "<f8"))]
                own, upper, lower, work = assign(x, *numbers, layout)
                d = squared(x, layout.at[own])
                sums = [x[own == j].sum(axis=0) for j in range(k)]
                new = {
                    "own": pa.array([own.astype("<i4").tobytes()], pa.binary()), "upper": pa.array([upper.astype("<f8").tobytes()], pa.binary()), "lower": pa.array([lower.astype("<f8").tobytes()], pa.binary()),
                    "sizes": pa.array([np.bincount(own, minlength=k)], extra["sizes"]), "sums": pa.array([np.concatenate(sums)], extra["sums"]),
                    "spread": pa.array([[int(d[own == j].sum()) for j in range(k)]], extra["spread"]), "work": pa.array([work], pa.int64()),
                }
                yield pa.RecordBatch.from_arrays([new[c] if c in new else row.column(c) for c in names], names)

    return state.mapInArrow(run, state.schema)


def _total(state: DataFrame, column: str) -> list[int]:
    """The sums over all blocks of the elements of a list column: exact, aggregated where the blocks are."""
    rows = state.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return [int(r["v"]) for r in sorted(rows.collect(), key=lambda r: r["i"])]


def cluster(vectors: DataFrame, keep: list[str], order: Column, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, vector: str = "embedding") -> DataFrame:
    """``keep`` columns, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid``.

    Entries become floor(``scale`` * entry). Centroids start as the ``k`` vectors first in ``order``
    (ties: the smaller vector), then ``rounds`` times every vector goes to its nearest centroid and
    every non-empty centroid to the floor of the mean of its vectors; then vectors go once more.

    Vectors lie in packed blocks with their owners and bounds, so a round is a scan without a
    shuffle; only k * dims sums come together, exact at any size. The state of the last round is
    persisted, on disk where memory lacks, and dropped when the next one is there; a lost executor's
    blocks are computed again from the vectors, and the lineage is cut in every eighth round. Rounds
    stop early when no centroid has moved, as all further ones would change nothing.

    Left out: vectors that are null, have another length, or hold null or non-finite entries or some
    of LARGEST / scale and more, whose squared distances no long holds. Fewer than ``k`` vectors:
    that many centroids. Repeated rows are vectors of their own, so all of them get a row; equal
    centroids may start, and the smaller number wins. No rows: no rows. A kept column named like a
    result comes back with ``_in`` behind its name.
    """
    results = ["cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    there, back = carried(keep, results)
    v = F.col(f"`{vector}`")
    rows = vectors.where(usable(v, LARGEST / scale) & (F.size(v) == dims)).select(*there, order.alias("o"), grid(v, scale).alias("x"))
    first = rows.select("o", "x").orderBy("o", "x").limit(k).collect()
    spark = vectors.sparkSession
    if not first:
        none = spark.createDataFrame([], rows.drop("o", "x").schema.add("cluster", "integer").add("distance", "long").add("cluster_inertia", "long").add("inertia", "long").add("centroid", ArrayType(LongType())))
        return none.select(*back, *results)
    at = np.array([r["x"] for r in first], dtype=np.int64)
    k = len(at)

    empty = F.array().cast("array<bigint>")
    state = blocked(rows.drop("o")).withColumns({"own": F.lit(None).cast("binary"), "upper": F.lit(None).cast("binary"), "lower": F.lit(None).cast("binary"), "sizes": empty, "sums": empty, "spread": empty, "work": F.lit(0).cast("long")})
    state = _first_state(state, dims)
    held, layout = None, Layout(at)
    for r in range(rounds + 1):
        state = _pass(state, dims, layout)
        if r and r % ROUNDS_A_CUT == 0:
            state = checkpointed(state)
        else:
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
        sizes = _total(state, "sizes")
        if held is not None:
            held.unpersist()
        held = state
        if r == rounds:
            break
        sums = _total(state, "sums")
        new = np.array([[sums[j * dims + i] // sizes[j] if sizes[j] else int(at[j, i]) for i in range(dims)] for j in range(k)], dtype=np.int64)
        if (new == at).all():
            break
        at, layout = new, Layout(new, at)
    spread = _total(state, "spread")
    fits = lambda n: F.lit(n if n < 2**63 else None).cast("long")
    out = _rows(state.drop("sizes", "sums", "spread", "work", "upper", "lower"), dims, at)
    of = lambda values: F.element_at(F.array(*values), F.col("cluster") + 1)
    centroids = [F.array(*[F.lit(int(c)).cast("long") for c in row]) for row in at]
    return out.select(*back, "cluster", "distance", of([fits(s) for s in spread]).alias("cluster_inertia"), fits(sum(spread)).alias("inertia"), of(centroids).alias("centroid"))


def _first_state(blocks: DataFrame, dims: int) -> DataFrame:
    """Blocks whose vectors belong to the first centroid, at an unknown distance: the first pass scans them all."""
    names = blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                n = len(unpack(row.column("x")[0].as_py(), dims))
                new = {"own": np.zeros(n, "<i4"), "upper": np.full(n, np.inf, "<f8"), "lower": np.zeros(n, "<f8")}
                yield pa.RecordBatch.from_arrays([pa.array([new[c].tobytes()], pa.binary()) if c in new else row.column(c) for c in names], names)

    return blocks.mapInArrow(run, blocks.schema)


def _rows(state: DataFrame, dims: int, at: np.ndarray) -> DataFrame:
    """Blocks as rows again, with cluster and exact squared distance."""
    lists = [f for f in state.schema.fields if f.name not in ("x", "own")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.elementType.simpleString()}" for f in lists), "cluster int, distance long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own = np.frombuffer(row.column("own")[0].as_py(), "<i4")
                d = squared(unpack(row.column("x")[0].as_py(), dims), at[own])
                yield pa.RecordBatch.from_arrays([*(row.column(f.name).flatten() for f in lists), pa.array(own, pa.int32()), pa.array(d, pa.int64())], [*(f.name for f in lists), "cluster", "distance"])

    return state.mapInArrow(run, schema)


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    order = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    out = cluster(vectors, ["vec_id"], order)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def _op12_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The same rounds, one table each; a floor of a quotient from one that is cut towards zero."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS j, x FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        d = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        parts.append(f"a{r} AS MATERIALIZED (SELECT r, min(d)::BIGINT AS d, arg_min(j, (d, j)) AS j FROM (SELECT r, j, {d} AS d FROM v, c{r} c) GROUP BY 1)")
        if r < rounds:
            floor = "CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END"
            parts.append(f"m{r} AS MATERIALIZED (SELECT j, list({floor} ORDER BY i)::BIGINT[] AS x FROM (SELECT j, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(x) AS x, unnest(range({dims})) AS i FROM v JOIN a{r} USING (r)) GROUP BY 1, 2) GROUP BY 1)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (j))")
    return f"""WITH {', '.join(parts)} SELECT vec_id, a.j AS "cluster", d AS distance, (sum(d) OVER (PARTITION BY a.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.j = a.j"""


OP12_SQL = _op12_sql()
