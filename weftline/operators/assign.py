"""One-to-one assignment of descriptions to regions, and its error types."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores that differ by no more count as tied.
TIED = 1e-10


def candidate_matrix(left: DataFrame, right: DataFrame, frame: str, score) -> DataFrame:
    """(frame, i, j, s): every pair inside a frame, by an equi-join on the frame."""
    a = left.select(frame, F.col("pos").alias("i"), F.col("value").alias("_a"))
    b = right.select(F.col(frame).alias("_f"), F.col("pos").alias("j"), F.col("value").alias("_b"))
    return a.join(b, F.col(frame) == F.col("_f")).select(frame, "i", "j", score(F.col("_a"), F.col("_b")).alias("s"))


def hungarian(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The column of each row of a square matrix at the least total, and both sides' potentials."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    row_of = np.full(n + 1, n)  # column n stands for the row that is being placed
    for row in range(n):
        row_of[n], at = row, n
        low, back, used = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[at] != n:
            used[at] = True
            k = row_of[at]
            gap = np.where(used[:n], np.inf, cost[k] - u[k] - v[:n])
            better = gap < low
            low[better], back[better] = gap[better], at
            to = int(np.argmin(np.where(used[:n], np.inf, low)))
            step = low[to]
            u[row_of[used]] += step
            v[used] -= step
            low[~used[:n]] -= step
            at = to
        while at != n:
            row_of[at] = row_of[back[at]]
            at = back[at]
    column_of = np.empty(n, int)
    column_of[row_of[:n]] = np.arange(n)
    return column_of, u[:n], v[:n]


def _reroute(tight: np.ndarray, column_of: np.ndarray, row_of: np.ndarray, i: int, j: int) -> bool:
    """Give row ``i`` column ``j`` if the rows after ``i`` can all keep tight columns; changes both maps."""
    lost, free = int(row_of[j]), int(column_of[i])
    back, queue = {}, [lost]
    seen = np.zeros(len(tight), bool)
    seen[column_of[: i + 1]] = True  # columns of settled rows
    seen[[free, j]] = False, True
    for row in queue:
        for col in np.flatnonzero(tight[row] & ~seen).tolist():
            seen[col], back[col] = True, row
            if col == free:
                while True:
                    row = back[col]
                    column_of[row], col = col, int(column_of[row])
                    row_of[column_of[row]] = row
                    if row == lost:
                        column_of[i], row_of[j] = j, i
                        return True
            queue.append(int(row_of[col]))
    return False


def best_pairs(score: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) of the largest total, as many as the shorter side; of tied ones the smallest list."""
    m, n = score.shape
    size = max(m, n)
    cost = np.zeros((size, size))
    cost[:m, :n] = -score
    column_of, u, v = hungarian(cost)
    # every assignment of tight edges has the least cost, and no other has
    tight = cost - u[:, None] - v[None, :] <= TIED
    tight[np.arange(size), column_of] = True
    row_of = np.empty(size, int)
    row_of[column_of] = np.arange(size)
    for i in range(m):
        for j in np.flatnonzero(tight[i, : column_of[i]]).tolist():
            if row_of[j] > i and _reroute(tight, column_of, row_of, i, j):
                break
    return [(i, int(column_of[i])) for i in range(m) if column_of[i] < n]


def assign(matrix: DataFrame, frame: str) -> DataFrame:
    """(frame, i, j, s) of the assignment with the largest total; ties go to the smallest j in order of i.

    The Hungarian algorithm, for frames of every size. Pairs that the matrix lacks score 0.
    """

    def best(g: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(set(g["i"])), sorted(set(g["j"]))
        s = {(i, j): v for i, j, v in zip(g["i"], g["j"], g["s"], strict=True)}
        score = np.array([[s.get((i, j), 0.0) for j in cols] for i in rows])
        chosen = [(rows[i], cols[j]) for i, j in best_pairs(score)]
        return pd.DataFrame({frame: g[frame].iloc[0], "i": [i for i, _ in chosen], "j": [j for _, j in chosen], "s": [s.get(x, 0.0) for x in chosen]})

    return matrix.groupBy(frame).applyInPandas(best, matrix.select(frame, "i", "j", "s").schema)


#: Sides of up to so many columns go through the subset table, larger ones through the Hungarian algorithm.
MOST_COLUMNS = 8
#: A matching's value: sums of scores in billionths, times this, plus the number of pairs.
PAIRS_BELOW = 4096


def _subset_best(rows: Column) -> Column:
    """The best value of a one-to-one choice from ``rows`` (array of arrays of struct<bit, v>), one option at most from each.

    The table maps a set of used columns (a bit mask) to the best value so far; each row may use a
    free column or none. Of entries with one mask only the best goes on, so there are at most
    2^columns of them, however many rows.
    """
    entry = lambda m, v: F.struct(m.alias("mask"), v.alias("v"))

    def step(table: Column, options: Column) -> Column:
        taken = F.flatten(F.transform(table, lambda t: F.transform(F.filter(options, lambda o: t["mask"].bitwiseAND(o["bit"]) == 0), lambda o: entry(t["mask"].bitwiseOR(o["bit"]), t["v"] + o["v"]))))
        ordered = F.transform(F.array(F.array_sort(F.concat(table, taken))), lambda x: F.filter(x, lambda e, k: (k == F.size(x) - 1) | (F.get(x, k + 1)["mask"] != e["mask"])))
        return F.get(ordered, 0)

    start = F.array(entry(F.lit(0).cast("long"), F.lit(0).cast("long")))
    return F.aggregate(rows, start, step, lambda table: F.array_max(F.transform(table, lambda t: t["v"])))


def best_matching(edges: DataFrame, pair: list[str]) -> DataFrame:
    """``pair``, matched, total: the one-to-one choice of edges (i, j, s) with the largest sum of scores, of equal ones that of more edges.

    Exact in every case: pairs whose edges share no end need no choice; those with up to
    MOST_COLUMNS different j are settled by a table over subsets in column functions; larger ones by
    the Hungarian algorithm, a pair at a time. Scores count in billionths, so that sums are exact.
    """
    v = F.round(F.col("s") * 1e9).cast("long") * PAIRS_BELOW + 1
    by_row = edges.select(*pair, "i", "j", v.alias("v")).groupBy(*pair, "i").agg(F.collect_list(F.struct("j", "v")).alias("options"))
    g = by_row.groupBy(*pair).agg(F.collect_list(F.struct("i", "options")).alias("rows"))
    columns = F.array_distinct(F.flatten(F.transform("rows", lambda r: F.transform(r["options"], lambda o: o["j"]))))
    all_options = F.aggregate("rows", F.lit(0), lambda n, r: n + F.size(r["options"]))
    g = g.withColumn("columns", columns).withColumn("simple", (F.size("rows") == all_options) & (F.size("columns") == all_options))
    coded = F.transform("rows", lambda r: F.transform(r["options"], lambda o: F.struct(F.call_function("shiftleft", F.lit(1).cast("long"), (F.array_position(F.col("columns"), o["j"]) - 1).cast("int")).alias("bit"), o["v"].alias("v"))))
    alone = F.aggregate(F.flatten(F.transform("rows", lambda r: F.transform(r["options"], lambda o: o["v"]))), F.lit(0).cast("long"), lambda a, b: a + b)
    small = g.where(F.size("columns") <= MOST_COLUMNS).select(*pair, F.when(F.col("simple"), alone).otherwise(_subset_best(coded)).alias("best"))
    simple = g.where((F.size("columns") > MOST_COLUMNS) & F.col("simple")).select(*pair, alone.alias("best"))
    large = g.where((F.size("columns") > MOST_COLUMNS) & ~F.col("simple")).select(*pair, "rows")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = []
            for rows in batch.pop("rows"):
                where = {j: k for k, j in enumerate(sorted({o["j"] for r in rows for o in r["options"]}))}
                score = np.zeros((len(rows), len(where)))
                for i, r in enumerate(sorted(rows, key=lambda r: r["i"])):
                    for o in r["options"]:
                        score[i, where[o["j"]]] = o["v"]
                best.append(int(sum(score[x] for x in best_pairs(score))))
            yield batch.assign(best=best)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.select(*pair).schema.fields)
    done = small.unionByName(simple).unionByName(large.mapInPandas(run, f"{fields}, best long"))
    return done.select(*pair, F.pmod("best", F.lit(PAIRS_BELOW)).alias("matched"), (F.floor(F.col("best") / PAIRS_BELOW) / 1e9).alias("total"))


def own_and_other(matrix: DataFrame, frame: str) -> DataFrame:
    """(frame, i, own, other): the score with the own region and the best with any other."""
    return matrix.groupBy(frame, "i").agg(F.max(F.when(F.col("i") == F.col("j"), F.col("s"))).alias("own"), F.max(F.when(F.col("i") != F.col("j"), F.col("s"))).alias("other"))


def error_type(own: Column, other: Column, accept: float = 0.5, margin: float = 0.1) -> Column:
    """matched, ambiguous, wrong_box or mismatch; thresholds are ours."""
    o = F.coalesce(other, F.lit(0.0))
    return (
        F.when((own >= accept) & (own - o >= margin), F.lit("matched"))
        .when((own >= accept) & (own >= o), F.lit("ambiguous"))
        .when(o >= accept, F.lit("wrong_box"))
        .otherwise(F.lit("mismatch"))
    )


def runs(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Run lengths of equal values (gaps and islands): by, value, start, n."""
    g = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - F.row_number().over(Window.partitionBy(*by, value).orderBy(order))
    return df.withColumn("_g", g).groupBy(*by, value, "_g").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("n")).drop("_g")
