"""Pairs inside blocks by tiles, and frame pairs of a scene, against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import dedup, frames, tiles
from weftline.operators.assign import PAIRS_BELOW


def test_billionths_round_half_up_as_decimals():
    assert frames.billionths(np.array([0.5, 0.0009765625, 0.3, 0.2999999995, 1.0, 2 / 3])).tolist() == [500_000_000, 976_563, 300_000_000, 300_000_000, 1_000_000_000, 666_666_667]


def test_matchings_against_all_choices():
    rng = random.Random(4)
    edges, want = [], {}
    for k in range(120):
        m, n = rng.randrange(1, 5), rng.randrange(1, 5)
        some = {(i, j): rng.randrange(300, 1000) for i in range(m) for j in range(n) if rng.random() < 0.6}
        edges += [(k, i, j, v) for (i, j), v in some.items()]
        sets = (c for r in range(len(some) + 1) if r <= min(m, n) for c in itertools.combinations(some, r))
        want[k] = max(sum(some[e] for e in c) for c in sets if len({i for i, _ in c}) == len(c) == len({j for _, j in c}))
    wide = [(i, j, 300 + (7 * i + 3 * j) % 50) for i in range(12) for j in range(12) if (i + j) % 3]
    edges += [(120, *e) for e in wide]
    k, i, j, v = (np.array(x) for x in zip(*edges, strict=True))
    got = frames.matchings(k, i, j, v, 122)
    assert {x: int(got[x]) for x in want} == want and got[121] == 0
    assert got[120] == frames.chosen(*(list(x) for x in zip(*wide, strict=True))) > 0


@pytest.mark.parametrize("chunk", [4, 256])
def test_frame_pairs_of_hot_scenes(spark, monkeypatch, chunk):
    """A scene of many frames goes by tiles, and gives what one tile gives."""
    monkeypatch.setattr(frames, "FRAME_CHUNK", chunk)
    rng = random.Random(8)
    word = lambda: [w for w in ("red", "blue", "ring", "bolt", "cap") if rng.random() < 0.4]
    region = lambda k: (k, None if rng.random() < 0.05 else word(), *(lambda x, y: map(float, (x, y, x + rng.randrange(40), y + rng.randrange(40))))(rng.randrange(20), rng.randrange(20)))
    rows = [(1 if f < 30 else None if f < 33 else f // 3, f, rng.getrandbits(63) if f % 5 else None, [region(k) for k in range(1, rng.randrange(2, 6))]) for f in range(60)]
    df = spark.createDataFrame(rows, "scene long, frame long, code long, regions array<struct<pos:int,w:array<string>,x1:double,y1:double,x2:double,y2:double>>")
    got = {(r["a"], r["b"]): (r["n"], r["d"], r["matched"], round(r["total"] * 1e9)) for r in frames.frame_matches(df.withColumn("n", F.size("regions").cast("long"))).collect()}
    want = {}
    for (s, a, c, p), (o, b, e, q) in itertools.combinations(rows, 2):
        if s is None or s != o:
            continue
        edges = []
        for i, w, x1, y1, x2, y2 in p:
            for j, v, X1, Y1, X2, Y2 in q:
                if w is None or v is None:
                    continue
                inter = max(min(x2, X2) - max(x1, X1), 0) * max(min(y2, Y2) - max(y1, Y1), 0)
                union = (x2 - x1) * (y2 - y1) + (X2 - X1) * (Y2 - Y1) - inter
                score = round(0.5 * (2.0 * len(set(w) & set(v)) / max(len(w) + len(v), 1)) + 0.5 * (inter / union if union > 0 else 0.0), 9)
                if score >= 0.3:
                    edges.append((i, j, round(score * 1e9) * PAIRS_BELOW + 1))
        best = max(sum(v for *_, v in c) for r in range(min(len(p), len(q)) + 1) for c in itertools.combinations(edges, r) if len({i for i, *_ in c}) == len(c) == len({j for _, j, _ in c}))
        want[a, b] = (max(len(p), len(q)), (c ^ e).bit_count() if c is not None and e is not None else 63, best % PAIRS_BELOW, best // PAIRS_BELOW)
    assert got == want


def vector_rows(n):
    rng = random.Random(11)
    rows = []
    for k in range(n):
        v = [float(rng.randrange(-3, 4)) for _ in range(8)]
        v = None if k % 41 == 0 else [*v[:3], None, *v[4:]] if k % 31 == 0 else [0.0] * 8 if k % 29 == 0 else v[:7] if k % 23 == 0 else [float("nan"), *v[1:]] if k % 37 == 0 else v
        rows.append((k * 7 % n, None if k % 19 == 0 else "xy"[k % 3 == 0], None if k % 43 == 0 else rng.getrandbits(16) - (1 << 15), v))
    return rows


@pytest.mark.parametrize("chunk", [20, 8192])
def test_near_pairs_as_the_plain_join(spark, monkeypatch, chunk):
    """What a join of whole blocks on the gate gives, for one tile of a block and for many."""
    monkeypatch.setattr(tiles, "VECTOR_CHUNK", chunk)
    monkeypatch.setattr(tiles, "CODE_CHUNK", chunk)
    df = spark.createDataFrame(vector_rows(220), "id long, label string, code long, v array<double>").cache()
    gate = (4, 7, 0.2)
    within = lambda a, b: dedup.near(X.hamming(F.col(f"{a}.code"), F.col(f"{b}.code")), X.cosine(F.col(f"{a}.v"), F.col(f"{b}.v")), gate)
    want = {tuple(r) for r in dedup.blocked_pairs(df, "id", [F.col("label")], within).collect()}
    got = [tuple(r) for r in tiles.near_pairs(df.where("label is not null"), ["label"], "id", "code", gate, "v").select("a", "b").collect()]
    assert set(got) == want and len(got) == len(want) > 300
    plain = {tuple(r) for r in dedup.blocked_pairs(df, "id", [F.col("label")], lambda a, b: X.hamming(F.col(f"{a}.code"), F.col(f"{b}.code")) <= 5).collect()}
    got = tiles.near_pairs(df.withColumn("twice", F.col("id") * 2), ["label"], "id", "code", (5, 5, 0.0), carry="twice").collect()
    assert {(r["a"], r["b"]) for r in got} > plain and all((r["twice_a"], r["twice_b"]) == (2 * r["a"], 2 * r["b"]) for r in got)  # nulls are a block
    codes = {r[0]: r[2] for r in vector_rows(220)}
    assert all(r["d"] == ((codes[r["a"]] ^ codes[r["b"]]) & (2**64 - 1)).bit_count() for r in got)


@pytest.mark.parametrize("chunk", [20, 8192])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(tiles, "VECTOR_CHUNK", chunk)
    df = spark.createDataFrame(vector_rows(220), "id long, label string, code long, v array<double>").where("label is not null").cache()
    for gate in ((1, 3, 0.5), (4, 5, 0.2)):
        pairs, links = (tiles.near_pairs(df, ["label"], "id", "code", gate, "v", links=x) for x in (False, True))
        of = lambda edges: {tuple(r) for r in dedup.representatives(df, edges, "id").collect()}
        assert of(links) == of(pairs) and links.count() <= pairs.count() > 0


def test_a_tile_of_copies_gives_few_links(spark):
    """Copies are all pairs of each other, but need only so many links as rows."""
    df = spark.range(1000).select("id", F.lit("x").alias("label"), F.lit(5).cast("long").alias("code"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    assert tiles.near_pairs(df, ["label"], "id", "code", (0, 0, 0.0), "v").count() == 499_500
    assert {tuple(r)[:2] for r in tiles.near_pairs(df, ["label"], "id", "code", (0, 0, 0.0), "v", links=True).collect()} == {(0, k) for k in range(1, 1000)}


def test_text_codes_are_counted_in_arrays(spark):
    """The code of hashed counts, as column functions give it, without a pass over the text for each bucket."""
    texts = [None, "", " !", "one", "The cat, the CAT and the dog", "İx K9 café", "a b " * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")

    def want(t):
        w = re.findall("[a-z0-9]+", (t or "").lower())
        v = [0] * 64
        for g in [*w, *(f"{a} {b}" for a, b in itertools.pairwise(w))]:
            v[int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 64] += 1
        return sum((v[i + 1] > v[i]) << (62 - i) for i in range(63)) if w else None

    got = df.select("id", X.text_code(F.col("t")).alias("code")).orderBy("id")
    assert [r["code"] for r in got.collect()] == [want(t) for t in texts]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambdafunction" not in plan
