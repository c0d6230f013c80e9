"""Literal cases of the scalar functions and metrics."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import geometry as G
from weftline.functions import reward as R
from weftline.functions import text as X
from weftline.operators import metrics as M


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_quantise(spark):
    assert one(spark, G.quantise(F.lit(1280.0), 1280)) == 999
    assert one(spark, G.quantise(F.lit(914.198), 1280)) == 714
    assert one(spark, G.quantise(F.lit(-3.0), 1280)) == 0


@pytest.mark.parametrize(("words", "score"), [(18, 1.0), (24, 1.0), (12, -0.5), (17, -0.5), (25, -0.5), (28, -0.5), (11, -1.0), (29, -1.0)])
def test_length_score(spark, words, score):
    assert one(spark, X.length_score(F.lit(words))) == score


def test_small_gate(spark):
    assert one(spark, G.small_input(F.lit(95), F.lit(30000))) == "short_edge"
    assert one(spark, G.small_input(F.lit(96), F.lit(25000))) is None
    assert one(spark, G.small_input(F.lit(96), F.lit(24999))) == "area"


def test_reward(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, R.reward(*lit(1, 0, 1, 1, 0), F.lit(False))) == pytest.approx(0.60)
    assert one(spark, R.reward(*lit(1, 0, 1, 1, 0), F.lit(True))) == -1.0
    assert one(spark, R.alpha(F.lit(748))) == pytest.approx(0.5)
    assert one(spark, R.alpha(F.lit(0))) == pytest.approx(0.1)


@pytest.mark.parametrize(("text", "bad"), [("", True), (" {\"a\": 1}", True), ("a | b", True), ("A man walks.", False), (None, True)])
def test_invalid_output(spark, text, bad):
    assert one(spark, X.invalid_output(F.lit(text).cast("string"))) is bad


def test_rouge_and_overlap(spark):
    a, b = F.split(F.lit("a b c d a"), " "), F.split(F.lit("b a d a x"), " ")
    assert one(spark, X.lcs_length(a, b)) == 3
    assert one(spark, X.rouge_l(a, b)) == pytest.approx(0.6)


def test_overlap_counts_repeats(spark):
    from weftline.operators import metrics

    rows = spark.createDataFrame([(1, "a b c d a".split(), "b a d a x".split()), (2, [], ["a"]), (3, ["a"] * 50_000, ["a"] * 40_000)], "id long, a array<string>, b array<string>")
    assert sorted(tuple(r) for r in metrics.token_overlap(rows, ["id"], "a", "b").collect()) == [(1, 5, 5, 4), (2, 0, 1, 0), (3, 50_000, 40_000, 40_000)]


def test_attribute_traps(spark):
    def found(text):
        return {k for k, c in X.attributes(F.lit(text)).items() if one(spark, c)}

    assert found("a woman in a black dress") == {"colour", "top", "bottom"}
    assert found("red background, a man walking") == {"pose"}
    assert found("holding a jacket") == {"held"} and found("wearing a jacket") == {"top"}
    assert found("holding a backpack") == {"held"} and found("wearing a backpack") == {"carried"}
    assert found("long curly hair and a bald spot") == {"hair"}
    assert [one(spark, X.closed_colour(F.lit(t))) for t in ("light grey coat", "RED and blue", "teal", "blackened", "")] == ["gray", "red", "unknown", "unknown", "unknown"]


@pytest.mark.parametrize(("rgb", "want"), [((255, 255, 255), (100, 0, 0)), ((0, 0, 0), (0, 0, 0)), ((255, 0, 0), (53.24, 80.09, 67.20)), ((0, 0, 255), (32.30, 79.19, -107.86))])
def test_lab(spark, rgb, want):
    from weftline.functions import geometry

    assert [one(spark, c) for c in geometry.lab(*[F.lit(float(x)) for x in rgb])] == pytest.approx(want, abs=0.02)


def test_snap_and_locs(spark):
    assert [one(spark, X.snap_score(F.lit(x))) for x in ("0.6", "0.7", "bad", "3", "-1")] == [0.5, 0.75, 0.0, 1.0, 0.0]
    parts = one(spark, X.parse_regions(F.lit("man <loc_1><loc_2><loc_3><loc_4><sep>dog <loc_1><loc_2><loc_3><sep>cat <loc_1><loc_2><loc_3><loc_1000>")))
    assert [(p["description"], p["loc"]) for p in parts] == [("man", [1, 2, 3, 4]), ("dog", None), ("cat", None)]


def test_attribute_outcomes(spark):
    rows = [(1, ["unknown"], "red"), (2, ["unknown"], "none"), (3, ["red"], "unknown"), (4, ["dark", "blue"], "blue"), (5, ["dark red"], "red")]
    got = {r["id"]: r for r in M.attribute_outcomes(spark.createDataFrame(rows, "id int, truth array<string>, gen string")).collect()}
    assert (got[1]["n_fab"], got[1]["tp"], got[1]["fp"], got[1]["fn"]) == (1, 0, 0, 0)
    assert (got[2]["n_fab"], got[2]["n_gen"], got[2]["fn"]) == (0, 0, 0)
    assert (got[3]["fn"], got[3]["fp"]) == (1, 0)
    assert (got[4]["tp"], got[4]["n_fab"]) == (1, 0)
    assert got[5]["tp"] == pytest.approx(2 / 3) and got[5]["fp"] == pytest.approx(1 / 3)
    f = M.f1(F.lit(0.75), F.lit(0.25), F.lit(0.25))[2]
    assert one(spark, f) == pytest.approx(0.75)


def test_greedy_extras_brute(spark):
    import random

    rng = random.Random(1)
    words = ["red", "blue", "bag", "hat", "red bag", "blue hat", "old red bag"]
    cases = [([rng.choice(words) for _ in range(rng.randrange(4))], [rng.choice(words) for _ in range(rng.randrange(4))]) for _ in range(60)]

    def dice(a, b):
        a, b = set(a.split()), set(b.split())
        return 2 * len(a & b) / (len(a) + len(b))

    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t array<string>, g array<string>")
    for r in rows.select("i", M.greedy_extras(F.col("t"), F.col("g")).alias("m")).collect():
        t, g = cases[r["i"]]
        pairs = sorted((-dice(x, y), j, k) for j, y in enumerate(g) for k, x in enumerate(t) if dice(x, y) >= 0.5)
        ui, uj, soft = set(), set(), 0.0
        for s, j, k in pairs:
            if j not in ui and k not in uj:
                ui.add(j)
                uj.add(k)
                soft -= s
        assert (r["m"]["hits"], r["m"]["n_fab"], r["m"]["fn"]) == (len(ui), len(g) - len(ui), len(t) - len(uj))
        assert r["m"]["soft"] == pytest.approx(soft, abs=1e-5)
