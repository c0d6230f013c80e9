"""Shadows, stripes and plaids on planted regions."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import geometry as G
from weftline.operators import colours

RED, BLUE, WHITE, BLACK, GREY = (200, 30, 30), (30, 30, 200), (250, 250, 250), (15, 15, 15), (128, 128, 128)


def shade(c, k):
    return tuple(v * k for v in c)


def test_shadows_of_one_colour_merge(spark):
    rows = []
    for roi, parts in {1: [(shade(RED, k), 10) for k in (1.0, 0.85, 0.7, 0.55)], 2: [(RED, 30), (shade(RED, 0.8), 20), (BLUE, 50)], 3: [(WHITE, 40), (BLACK, 40), (GREY, 20)], 4: [(WHITE, 5)]}.items():
        rows += [(roi, *map(float, c)) for c, n in parts for _ in range(n)]
    got = colours.shadow_merge(colours.colour_clusters(spark.createDataFrame(rows, "roi long, r double, g double, b double"))).collect()
    by = {roi: sorted((r["kind"], r["n"], r["share"]) for r in got if r["roi"] == roi) for roi in (1, 2, 3, 4)}
    assert by == {1: [("chromatic", 40, 1.0)], 2: [("chromatic", 50, 0.5)] * 2, 3: [("neutral", 20, 0.2), ("neutral", 40, 0.4), ("neutral", 40, 0.4)], 4: [("neutral", 5, 1.0)]}
    assert max(r["members"] for r in got if r["roi"] == 1) > 1
    assert colours.shadow_merge(colours.colour_clusters(spark.createDataFrame([], "roi long, r double, g double, b double"))).count() == 0


def test_merge_against_union_find(spark):
    rng = random.Random(1)
    rows = [(i % 3, *(float(rng.randrange(256)) for _ in range(3))) for i in range(260)]
    clusters = colours.colour_clusters(spark.createDataFrame(rows, "roi long, r double, g double, b double"))
    got = {(r["roi"], r["colour"]): (r["members"], r["n"]) for r in colours.shadow_merge(clusters).collect()}
    c = clusters.collect()
    root = list(range(len(c)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(c):
        for j, y in enumerate(c[:i]):
            grey = x["chroma"] < colours.NEUTRAL_CHROMA
            if x["roi"] == y["roi"] and grey == (y["chroma"] < colours.NEUTRAL_CHROMA):
                d = abs(x["hue"] - y["hue"])
                if x["l"] == y["l"] if grey else max(abs(x["a"] - y["a"]), abs(x["b"] - y["b"])) <= colours.AB_REACH and min(d, 360 - d) <= colours.SAME_HUE:
                    root[top(i)] = top(j)
    want = {}
    for i, x in enumerate(c):
        want.setdefault(top(i), []).append(x)
    assert got == {(g[0]["roi"], min(x["cluster"] for x in g)): (len(g), sum(x["n"] for x in g)) for g in want.values()}


@pytest.mark.parametrize(("x", "y", "d"), [(350.0, 10.0, 20.0), (10.0, 350.0, 20.0), (0.0, 180.0, 180.0), (90.0, 80.0, 10.0)])
def test_hue_is_a_circle(spark, x, y, d):
    assert spark.range(1).select(G.hue_distance(F.lit(x), F.lit(y)).alias("d")).first()["d"] == d


def picture(roi, colour, size=24):
    return [(roi, y, x, colour(y, x)) for y in range(size) for x in range(size)]


def test_textures_of_planted_regions(spark):
    rng = random.Random(2)
    kinds = {
        1: (lambda y, x: 0, "plain"), 2: (lambda y, x: x // 3 % 2, "stripe"), 3: (lambda y, x: y // 4 % 3, "stripe"), 4: (lambda y, x: x // 2 % 2 + 2 * (y // 5 % 2), "plaid"), 5: (lambda y, x: rng.randrange(4), "mixed"),
        6: (lambda y, x: (x // 3 + y // 3) % 2, "plaid"), 7: (lambda y, x: int(x > 11), "mixed"), 8: (lambda y, x: int((x, y) == (3, 3)), "plain"),
    }
    rows = [r for roi, (f, _) in kinds.items() for r in picture(roi, f)]
    got = {r["roi"]: r for r in colours.textures(spark.createDataFrame(rows, "roi long, y long, x long, colour long")).collect()}
    assert {k: r["texture"] for k, r in got.items()} == {k: t for k, (_, t) in kinds.items()}
    assert (got[2]["x_period"], got[2]["x_regular"], got[2]["y_changes"]) == (6, 1.0, 0.0) and got[3]["y_period"] == 8


def test_penalty_depends_on_texture(spark):
    rng = random.Random(3)
    palette = [RED, BLUE, WHITE, (30, 160, 60)]
    kinds = {1: lambda y, x: 0, 2: lambda y, x: x // 3 % 2, 3: lambda y, x: rng.randrange(4), 4: lambda y, x: int(rng.random() < 0.05)}
    rows = [(*r, *map(float, palette[r[3]])) for roi, f in kinds.items() for r in picture(roi, f)]
    got = {r["roi"]: (r["verdict"], r["penalty"]) for r in colours.peak_gate(spark.createDataFrame(rows, "roi long, y long, x long, colour long, r double, g double, b double")).collect()}
    assert got == {1: ("pure", 0.0), 2: ("multi", 0.3), 3: ("multi", 0.6), 4: ("pure", 0.0)}
