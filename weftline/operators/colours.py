"""Colours of regions from their pixels: histogram peaks, purity, shadows of one colour, stripes and plaids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import geometry as G
from weftline.operators.assign import runs
from weftline.operators.graph import connected_components

#: Reach of smoothing and of the merge of near peaks, in bins of the 128 by 128 plane.
NEAR_BINS, MERGE_BINS = 1, 4
#: Clusters of pixels: bins of L, and of a* and b*; our own limits of what is neutral and what is one hue.
L_BINS, AB_BINS = 8, 32
NEUTRAL_CHROMA, SAME_HUE, AB_REACH = 10.0, 15.0, 2
#: Our own limits of a texture, and the penalties of many colours in order of their texture.
REGULAR, CHANGES, LEAST_PERIOD = 0.75, 0.5, 4
PENALTY = {"plain": 0.6, "mixed": 0.6, "stripe": 0.3, "plaid": 0.3}


def square(reach: int) -> Column:
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in range(-reach, reach + 1) for y in range(-reach, reach + 1)])


def ab_histogram(pixels: DataFrame) -> DataFrame:
    """(roi, a, b, n) of pixels (roi, r, g, b) in bins of the a*b* plane."""
    lab = G.lab(F.col("r"), F.col("g"), F.col("b"))
    return pixels.groupBy("roi", G.ab_bin(lab[1]).alias("a"), G.ab_bin(lab[2]).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def highest(bins: DataFrame, reach: int) -> DataFrame:
    """Bins that no bin within ``reach`` outweighs (ties: the smaller bin): shifted copies and an aggregate, no theta join."""
    key = F.struct(F.col("s").alias("s"), (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))
    spread = bins.select("roi", "a", "b", key.alias("key"), F.explode(square(reach)).alias("d"))
    best = spread.groupBy("roi", (F.col("a") + F.col("d.x")).alias("a"), (F.col("b") + F.col("d.y")).alias("b")).agg(F.max("key").alias("best"))
    return bins.join(best, ["roi", "a", "b"]).where((F.col("best.na") == -F.col("a")) & (F.col("best.nb") == -F.col("b"))).select("roi", "a", "b", "s")


def peaks(histogram: DataFrame) -> DataFrame:
    """(roi, a, b, s): smoothed bins, their local peaks, and of near peaks the highest."""
    spread = histogram.select("roi", "a", "b", "n", F.explode(square(NEAR_BINS)).alias("d"))
    weight = F.element_at(F.array(F.lit(4), F.lit(2), F.lit(1)), F.abs("d.x") + F.abs("d.y") + 1)
    smooth = spread.groupBy("roi", (F.col("a") + F.col("d.x")).alias("a"), (F.col("b") + F.col("d.y")).alias("b")).agg(F.sum(F.col("n") * weight).cast("long").alias("s"))
    return highest(highest(smooth, NEAR_BINS), MERGE_BINS)


def purity(histogram: DataFrame) -> DataFrame:
    """(roi, peaks, u): the share of pixels within reach of the highest peak."""
    key = F.struct("s", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))
    main = peaks(histogram).groupBy(F.col("roi").alias("r")).agg(F.max(key).alias("p"), F.count(F.lit(1)).alias("peaks"))
    j = histogram.join(main, F.col("roi") == F.col("r"))
    mine = (F.abs(F.col("a") + F.col("p.na")) <= MERGE_BINS) & (F.abs(F.col("b") + F.col("p.nb")) <= MERGE_BINS)
    return j.groupBy("roi").agg(F.first("peaks").alias("peaks"), (F.sum(F.when(mine, F.col("n"))) / F.sum("n")).alias("u"))


# -- shadows ---------------------------------------------------------------------------------------


def colour_clusters(pixels: DataFrame) -> DataFrame:
    """(roi, cluster, l, a, b, chroma, hue, n): pixels (roi, r, g, b) in coarse bins of L, a* and b*, with chroma and hue (degrees) of the bin's centre."""
    light, a, b = G.lab(F.col("r"), F.col("g"), F.col("b"))
    l_bin = F.least(F.greatest(F.floor(F.round(light, 9) * (L_BINS / 100)), F.lit(0)), F.lit(L_BINS - 1)).cast("long")
    g = pixels.groupBy("roi", l_bin.alias("l"), G.ab_bin(a, AB_BINS).alias("a"), G.ab_bin(b, AB_BINS).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    centre = lambda c: (F.col(c) + 0.5) * (256 / AB_BINS) - 128
    return g.select("roi", ((F.col("l") * AB_BINS + F.col("a")) * AB_BINS + F.col("b")).alias("cluster"), "l", "a", "b", G.chroma(centre("a"), centre("b")).alias("chroma"), G.hue(centre("a"), centre("b")).alias("hue"), "n")


def shadow_merge(clusters: DataFrame) -> DataFrame:
    """(roi, colour, kind, members, n, share): clusters that are one colour in other light become one, weights added up.

    Two chromatic clusters of a region are one colour if their hues are near on the circle and their
    a*b* bins near, whatever their lightness; neutral ones (small chroma) only if they share a bin of
    lightness, so that black, grey and white stay apart. Colours are the components of that relation,
    named by their smallest cluster. Near bins are found by shifted copies, so a region of many
    clusters costs their number, not its square.
    """
    rows = clusters.withColumn("neutral", F.col("chroma") < NEUTRAL_CHROMA)
    node = lambda roi, cluster: F.struct(roi.alias("roi"), cluster.alias("cluster"))
    colour = rows.where("not neutral").select("roi", "cluster", "l", "a", "b", "hue")
    spread = colour.select("roi", F.col("cluster").alias("c1"), F.col("hue").alias("h1"), F.explode(square(AB_REACH)).alias("d"), "a", "b")
    spread = spread.select("roi", "c1", "h1", (F.col("a") + F.col("d.x")).alias("a"), (F.col("b") + F.col("d.y")).alias("b"))
    near = spread.join(colour.select("roi", "a", "b", F.col("cluster").alias("c2"), F.col("hue").alias("h2")), ["roi", "a", "b"])
    near = near.where((F.col("c1") < F.col("c2")) & (G.hue_distance(F.col("h1"), F.col("h2")) <= SAME_HUE)).select(node(F.col("roi"), F.col("c1")).alias("x"), node(F.col("roi"), F.col("c2")).alias("y"))
    grey = rows.where("neutral").groupBy("roi", "l").agg(F.min("cluster").alias("c1"), F.collect_set("cluster").alias("all"))
    star = grey.select("roi", "c1", F.explode("all").alias("c2")).where("c1 < c2").select(node(F.col("roi"), F.col("c1")).alias("x"), node(F.col("roi"), F.col("c2")).alias("y"))
    comp = connected_components(near.unionByName(star), "x", "y").select(F.col("node.roi").alias("r"), F.col("node.cluster").alias("k"), F.col("component.cluster").alias("colour"))
    named = rows.join(comp, (F.col("roi") == F.col("r")) & (F.col("cluster") == F.col("k")), "left").withColumn("colour", F.coalesce("colour", "cluster"))
    g = named.groupBy("roi", "colour").agg(F.first("neutral").alias("neutral"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"))
    total = named.groupBy(F.col("roi").alias("r")).agg(F.sum("n").alias("total"))
    return g.join(total, F.col("roi") == F.col("r")).select("roi", "colour", F.when(F.col("neutral"), "neutral").otherwise("chromatic").alias("kind"), "members", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


# -- stripes and plaids ----------------------------------------------------------------------------


def _axis(pixels: DataFrame, line: str, along: str, name: str) -> DataFrame:
    """(roi, changes, period, regular) of the runs along one axis: colour changes a line, twice the most common inner run, and how many inner runs have that length."""
    r = runs(pixels.select("roi", line, along, "colour"), ["roi", line], along, "colour")
    ends = Window.partitionBy("roi", line)
    r = r.withColumns({"first": F.min("start").over(ends), "last": F.max("start").over(ends)})
    inner = (F.col("start") > F.col("first")) & (F.col("start") < F.col("last"))  # a run at the border may be cut
    lengths = r.groupBy("roi", F.col("n").alias("length")).agg(F.count_if(inner).alias("inner"), F.count(F.lit(1)).alias("all"))
    best = F.max(F.struct(F.col("inner"), (-F.col("length")).alias("shorter")))
    g = lengths.groupBy("roi").agg(F.sum("all").alias("all"), F.sum("inner").alias("inner"), best.alias("best"))
    lines = pixels.groupBy(F.col("roi").alias("_r")).agg(F.count_distinct(line).alias("lines"))
    g = g.join(lines, F.col("roi") == F.col("_r"))
    has = F.col("inner") > 0
    return g.select(
        F.col("roi").alias(f"{name}_roi"), F.round(F.col("all") / F.col("lines") - 1, 6).alias(f"{name}_changes"),
        F.when(has, -2 * F.col("best.shorter")).alias(f"{name}_period"), F.round(F.when(has, F.col("best.inner") / F.col("inner")).otherwise(0.0), 6).alias(f"{name}_regular"))


def textures(pixels: DataFrame) -> DataFrame:
    """(roi, x_changes, x_period, x_regular, y_..., texture) of pixels (roi, y, x, colour).

    Runs of one colour along rows and along columns: even runs along one axis and hardly a change
    along the other are a stripe, even runs along both a plaid, hardly a change along both plain, all
    else mixed. Runs of single pixels are no stripes: noise has mostly such ones. Runs are gaps and islands: a window over each line of pixels, never over a region.
    """
    x, y = _axis(pixels, "y", "x", "x"), _axis(pixels, "x", "y", "y")
    j = x.join(y, F.col("x_roi") == F.col("y_roi"))
    even = lambda k: (F.col(f"{k}_changes") >= CHANGES) & (F.col(f"{k}_regular") >= REGULAR) & (F.col(f"{k}_period") >= LEAST_PERIOD)
    still = lambda k: F.col(f"{k}_changes") < CHANGES
    texture = F.when(still("x") & still("y"), "plain").when(even("x") & even("y"), "plaid").when((even("x") & still("y")) | (even("y") & still("x")), "stripe").otherwise("mixed")
    return j.select(F.col("x_roi").alias("roi"), "x_changes", "x_period", "x_regular", "y_changes", "y_period", "y_regular", texture.alias("texture"))


def peak_gate(pixels: DataFrame) -> DataFrame:
    """(roi, peaks, purity, texture, verdict, penalty) of pixels (roi, y, x, colour, r, g, b).

    Pure: at most one peak, or most pixels near the highest. Many colours cost by texture: a stripe or
    a plaid is meant to have them, so its penalty is milder.
    """
    u = purity(ab_histogram(pixels.select("roi", "r", "g", "b")))
    kinds = textures(pixels).select(F.col("roi").alias("_r"), "texture")
    j = u.join(kinds, F.col("roi") == F.col("_r"))
    pure = (F.col("peaks") <= 1) | (F.col("u") > 0.85)
    penalty = F.coalesce(*[F.when(F.col("texture") == k, F.lit(v)) for k, v in PENALTY.items()])
    return j.select("roi", "peaks", F.round("u", 6).alias("purity"), "texture", F.when(pure, "pure").otherwise("multi").alias("verdict"), F.when(pure, 0.0).otherwise(penalty).alias("penalty"))
