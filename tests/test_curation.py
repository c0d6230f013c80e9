"""Quotas, component splits, paired bootstraps, field pairs: against plain Python, with planted cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import metrics, splits
from weftline.sources import io


def poured(weights, limits, total):
    """Share by weight again and again, taking out groups that are full."""
    total, quota, open_ = min(total, sum(limits.values())), {}, set(weights)
    while True:
        rest = total - sum(limits[g] for g in weights if g not in open_)
        w = sum(weights[g] for g in open_)
        over = {g for g in open_ if rest * weights[g] / w >= limits[g]}
        if not over:
            return {g: rest * weights[g] / w if g in open_ else limits[g] for g in weights}
        open_ -= over
        if not open_:
            return dict(limits)


@pytest.mark.parametrize("seed", [1, 2])
def test_fill_reaches_the_total(spark, seed):
    rng = random.Random(seed)
    groups = {f"g{i}": (rng.choice([0.5, 1.0, 4.0, 90.0]), rng.choice([1, 2, 7, 50, 900])) for i in range(30)}
    df = spark.createDataFrame([(g, w, m) for g, (w, m) in groups.items()], "g string, weight double, most long")
    rows = sum(m for _, m in groups.values())
    for total in (17, rows // 2, rows - 1, rows * 2):
        got = {r["g"]: r["quota"] for r in splits.fill(df, "g", total).collect()}
        want = poured({g: w for g, (w, _) in groups.items()}, {g: m for g, (_, m) in groups.items()}, total)
        assert sum(got.values()) == min(total, rows) and all(abs(got[g] - want[g]) <= 1 and got[g] <= groups[g][1] for g in groups)


def test_allocate_loses_nothing_on_skewed_groups(spark):
    counts = [("hot", 100_000), ("warm", 60_000), *((f"s{i}", 3) for i in range(50)), ("mid", 5_000), (None, 40)]
    q = {r["s"]: r["quota"] for r in splits.allocate(spark.createDataFrame(counts, "s string, n long"), "s", 8_000).collect()}
    assert q["hot"] == q["warm"] == 2_000 and sum(q.values()) == 8_000  # by square roots alone the fifty groups could not take their share
    q = {r["s"]: r["quota"] for r in splits.allocate(spark.createDataFrame(counts, "s string, n long"), "s", 30_000).collect()}
    assert sum(q.values()) == 7_500 * 2 + 150 + 5_000 + 40
    assert splits.fill(spark.createDataFrame([], "g string, weight double, most long"), "g", 5).count() == 0


def test_component_split_keeps_similar_rows_together(spark):
    rng = random.Random(7)
    edges = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(90)) if a != b}
    nodes, e = spark.range(400).withColumnRenamed("id", "k"), spark.createDataFrame([*edges], "a long, b long")
    rows = splits.component_split(nodes, e, "k").collect()
    side = {r["k"]: r["split"] for r in rows}
    groups = {r["group_id"]: r["n"] for r in rows}
    assert len(side) == 400 and all(side[a] == side[b] for a, b in edges)
    assert all((r["reason"] == "singleton") == (r["members"] == 1) for r in rows) and sum(groups.values()) == 400
    test = sum(s == "test" for s in side.values())
    assert 40 - max(n for n in groups.values() if n <= 40) < test <= 40
    split = spark.createDataFrame([*side.items()], "k long, split string")
    assert splits.leaks(e, split, "k").count() == 0
    moved = split.withColumn("split", F.when(F.col("k") == min(edges)[0], F.lit("other")).otherwise(F.col("split")))
    assert splits.leaks(e, moved, "k").count() > 0  # a planted violation is found
    sized = splits.component_split(nodes, e, "k", size=F.when(F.col("k") < 50, 10).otherwise(1))
    assert sized.agg(F.sum(F.when(F.col("k") == F.col("group_id"), F.col("n")))).first()[0] == 50 * 10 + 350


def test_a_group_larger_than_the_share_stops_no_other(spark):
    g = spark.createDataFrame([("giant", 900), *((f"s{i}", 10) for i in range(10))], "g string, n long")
    s = {r["g"]: r["split"] for r in splits.grouped_split(g, "g").collect()}
    assert s["giant"] == "train" and sum(v == "test" for v in s.values()) == 10


def test_bootstrap_draws_whole_clusters(spark):
    rng = np.random.default_rng(2)
    stats = [(f"c{i:02}", float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 50, (17, 2)))]
    df = spark.createDataFrame(stats, "c string, a double, b double")
    got = {r["statistic"]: r for r in metrics.paired_bootstrap(df, "c", ["a", "b"], {"share": lambda s: s["a"] / (s["a"] + s["b"]), "gap": lambda s: s["a"] - s["b"]}, reps=300).collect()}
    x = np.array([s[1:] for s in stats])
    drawn = [x[[int(hashlib.md5(f"boot|{r}|{d}".encode()).hexdigest()[:8], 16) * 17 >> 32 for d in range(17)]].sum(axis=0) for r in range(300)]
    share, gap = [a / (a + b) for a, b in drawn], [a - b for a, b in drawn]
    for name, v, point in (("share", share, x[:, 0].sum() / x.sum()), ("gap", gap, x[:, 0].sum() - x[:, 1].sum())):
        assert (got[name]["low"], got[name]["high"], got[name]["point"], got[name]["reps"]) == (pytest.approx(np.quantile(v, 0.025), abs=1e-5), pytest.approx(np.quantile(v, 0.975), abs=1e-5), pytest.approx(point, abs=1e-5), 300)
    assert metrics.paired_bootstrap(df.where("false"), "c", ["a"], {"a": lambda s: s["a"]}, reps=5).count() == 0


def test_fields_pair_on_both_sides(spark):
    truth = spark.createDataFrame([(1, "hair", ["long"]), (1, "top", ["dark", "blue"]), (2, "hair", ["short"]), (None, "hair", ["x"])], "id long, field string, values array<string>")
    gen = spark.createDataFrame([(1, "top", ["dark", "blue"]), (1, "shoes", ["red"]), (3, "hair", ["none"]), (None, "hair", ["x"])], "id long, field string, values array<string>")
    got = {(r["id"], r["field"]): (r["tp"], r["fn"], r["n_fab"], r["n_gen"]) for r in metrics.attribute_outcomes(metrics.field_pairs(truth, gen, "id")).collect()}
    assert got == {
        (1, "hair"): (0.0, 1.0, 0, 0), (1, "top"): (pytest.approx(2 / 3), pytest.approx(1 / 3), 0, 1), (2, "hair"): (0.0, 1.0, 0, 0), (1, "shoes"): (0.0, 0.0, 1, 1), (3, "hair"): (0.0, 0.0, 0, 0), (None, "hair"): (1.0, 0.0, 0, 1),
    }


def test_completeness_of_predictions(spark):
    t = spark.createDataFrame([(1, 0), (2, 1)], "id long, quality int")
    p = spark.createDataFrame([(2, 1), (3, 0)], "id long, pred int")
    assert {r["id"]: (r["quality"], r["pred"], r["state"]) for r in io.paired(t, p, "id").collect()} == {1: (0, None, "no_prediction"), 2: (1, 1, "paired"), 3: (None, 0, "no_truth")}


def test_macro_means_of_classes(spark):
    conf = spark.createDataFrame([("a", "a", 6), ("a", "b", 2), ("b", "b", 1), ("c", "a", 1)], "truth string, pred string, n long")
    r = metrics.accuracy_and_macro(conf).first()
    p, c = (6 / 7, 1 / 3, 0), (6 / 8, 1, 0)
    f = [2 * x * y / (x + y) if x + y else 0 for x, y in zip(p, c)]
    assert (r["accuracy"], r["macro_p"], r["macro_r"], r["macro_f1"], r["classes"]) == (0.7, pytest.approx(sum(p) / 3, abs=1e-5), pytest.approx(sum(c) / 3, abs=1e-5), pytest.approx(sum(f) / 3, abs=1e-5), 3)


def brute_matching(edges):
    """Every one-to-one choice of edges."""
    best = (0, 0)
    stack = [(0, 0, 0, frozenset(), frozenset())]
    while stack:
        k, total, n, left, right = stack.pop()
        if k == len(edges):
            best = max(best, (total, n))
            continue
        i, j, s = edges[k]
        stack.append((k + 1, total, n, left, right))
        if i not in left and j not in right:
            stack.append((k + 1, total + round(s * 1e9), n + 1, left | {i}, right | {j}))
    return best


def test_matching_is_optimal(spark):
    from weftline.operators import assign

    rng = random.Random(4)
    edges = {k: sorted({(rng.randrange(6), rng.randrange(6)): rng.choice([0.3, 0.5, round(rng.random(), 9)]) for _ in range(rng.randrange(1, 11))}.items()) for k in range(60)}
    edges = {k: [(i, j, s) for (i, j), s in e] for k, e in edges.items()}
    edges[100] = [(0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.85)]  # mutual best takes the 0.9 alone
    edges[101] = [(i, (i * 5 + d) % 12, 0.5 + 0.01 * ((i * 7 + d * 3) % 11)) for i in range(12) for d in range(3)]  # more columns than the table takes
    edges[102] = [(i, i + 50, 0.25) for i in range(40)]
    rows = [(k, i, j, s) for k, e in edges.items() for i, j, s in e]
    got = {r["k"]: (round(r["total"] * 1e9), r["matched"]) for r in assign.best_matching(spark.createDataFrame(rows, "k long, i int, j int, s double"), ["k"]).collect()}
    assert got.keys() == edges.keys()
    for k in range(60):
        assert got[k] == brute_matching(edges[k]), edges[k]
    assert got[100] == (1_650_000_000, 2) and got[102] == (10_000_000_000, 40)
    score = np.zeros((12, 12))
    for i, j, s in edges[101]:
        score[i, j] = s
    assert got[101][0] == round(sum(score[p] for p in assign.best_pairs(score)) * 1e9)


def test_rarity_and_coverage(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, 5))] + ([None] if i % 7 == 0 else [])) for i in range(80)] + [(200, None), (201, [])]
    df = spark.createDataFrame(rows, "k long, v array<string>")
    sets = {k: set(v or []) - {None} for k, v in rows}
    freq = {x: sum(x in s for s in sets.values()) for s in sets.values() for x in s}
    got = {r["k"]: r["rarity"] for r in splits.rarity(df, "k", "v").collect()}
    assert got == {k: pytest.approx(sum(1 / freq[x] for x in s), abs=1e-8) for k, s in sets.items()}
    open_, picks = set(freq), {}
    while open_:
        k = min(sets, key=lambda k: (-len(sets[k] & open_), k))
        picks[k] = len(sets[k] & open_)
        open_ -= sets[k]
    assert {r["k"]: r["gain"] for r in splits.coverage_order(df, "k", "v").collect()} == picks
    some = splits.diverse_subset(df, "k", "v", 3).orderBy("rk").collect()
    assert [r["k"] for r in some] == sorted(picks, key=lambda k: (-picks[k], k))[:3]
    assert splits.diverse_subset(df, "k", "v", 500).count() == 82 and splits.coverage_order(df.where("false"), "k", "v").count() == 0


def test_review_merge_reconciles(spark):
    from weftline.operators import review

    rng = random.Random(9)
    rows = [(i, rng.choice(["test", "train", "train"]), rng.choice(["reviewed", "reviewed", "rejected", "duplicate", "uncertain", "unreviewed"]), rng.choice(["regular", "second"]), rng.randrange(60)) for i in range(400)]
    edges = {(a, b) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(150)) if a < b}
    df = spark.createDataFrame(rows, "k long, split string, state string, origin string, content long")
    merged = review.merge(df, "k", spark.createDataFrame([*edges], "a long, b long"), F.col("content"))
    got = {r["k"]: r for r in merged.collect()}
    place = {k: r["place"] for k, r in got.items()}
    assert len(got) == 400
    for k, split, state, origin, _ in rows:
        r = got[k]
        if state in ("duplicate", "rejected"):
            assert (r["place"], r["rule"]) == ("removed", state)
        elif state != "reviewed" and r["rule"] is None:
            assert r["place"] == split
        elif state == "reviewed" and origin == "regular" and r["rule"] == "reviewed":
            assert r["place"] == "test"
    halves = [r for r in got.values() if r["state"] == "reviewed" and r["origin"] == "second"]
    assert sum(r["rule"] in ("halved", "leakage", "conflict") for r in halves) == len(halves)
    assert not any({place[a], place[b]} == {"test", "train"} for a, b in edges)  # no pair crosses
    content = {k: c for k, *_, c in rows}
    trained = {content[k] for k, r in got.items() if r["place"] == "train" and r["rule"] == "halved"}
    assert not any(r["place"] == "test" and content[k] in trained for k, r in got.items())
    assert {r["rule"] for r in got.values()} == {*review.STEPS, None}
    steps = sorted(review.ledger(merged).collect(), key=lambda r: r["step"])
    assert [r["rule"] for r in steps] == list(review.STEPS) and steps[0]["rows_in"] == 400
    for a, b in zip(steps, steps[1:]):
        assert a["rows_in"] - a["removed"] == a["rows_out"] == b["rows_in"]
    assert steps[-1]["rows_out"] == sum(p != "removed" for p in place.values()) and sum(r["claimed"] for r in steps) == sum(r["rule"] is not None for r in got.values())


def test_violations_are_found(spark, tmp_path):
    """FIL-3 and JOI-10 on tables with planted violations; on the given tables they have no rows."""
    from weftline.plans import registry

    turns = [("a", 0, "user", "x"), ("a", 1, "assistant", "y"), ("b", 0, "user", "x"), ("b", 1, "assistant", None), ("c", 0, "user", "x"), ("c", 2, "assistant", "y")]
    spark.createDataFrame(turns, "conv_id string, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert {r["conv_id"]: (r["boxes"], r["descriptions"]) for r in registry.QUERIES["fil_3_consistency"](spark, str(tmp_path)).collect()} == {"b": (2, 1), "c": (2, 2)}
    spark.createDataFrame([(1,), (2,)], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2,), (3,)], "doc_id long").write.parquet(str(tmp_path / "labels.parquet"))
    assert [r["doc_id"] for r in registry.QUERIES["joi_10_subset_invariant"](spark, str(tmp_path)).collect()] == [3]


@pytest.mark.parametrize(("radius", "bands"), [(0, True), (3, True), (8, True), (20, False)])
def test_hamming_pairs_find_all(spark, radius, bands):
    from weftline.operators import dedup

    rng = random.Random(radius)
    codes = [rng.getrandbits(63) for _ in range(150)]
    for c in codes[:60]:
        for b in rng.sample(range(63), rng.randrange(0, 12)):
            c ^= 1 << b
        codes.append(c)
    rows = [(i, "xy"[i % 2] if i % 9 else None, c) for i, c in enumerate(codes)] + [(900, "x", codes[1]), (901, "x", None)]
    classes = dedup.code_classes(spark.createDataFrame(rows, "id long, block string, code long"), "id", "block", "code")
    got, used = dedup.hamming_pairs(classes, radius)
    by = {}
    for i, b, c in rows:
        if c is not None:
            by.setdefault((b, c), []).append(i)
    groups = [(b, c, min(v), len(v)) for (b, c), v in by.items()]
    want = {(x[2], y[2], (x[1] ^ y[1]).bit_count(), x[3], y[3]) for x in groups for y in groups if x[0] == y[0] and x[2] < y[2] and (x[1] ^ y[1]).bit_count() <= radius}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) and used is bands
