"""Scoring (AGG-7..15, 19..22, 25, ARR-2, JOI-14, SNK-4, PRJ-12..14, FIL-7, 8, 15)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import geometry as G
from weftline.functions import text as X
from weftline.operators import colours
from weftline.operators import metrics as M
from weftline.plans.base import query
from weftline.plans.scalars import DICE_SQL, ROUGE_SQL, TURNS_SQL, turns

# Parts as samples: the next part's values stand for what was generated; some values mean "absent".
PAIRS_SQL = """f AS (SELECT p_partkey, p_brand AS session, 'name' AS field, CASE WHEN p_size % 9 = 0 THEN 'unknown' ELSE p_name END AS v FROM part
UNION ALL SELECT p_partkey, p_brand, 'type', CASE WHEN p_type = 'ECONOMY' THEN ' None ' ELSE p_type END FROM part),
p AS (SELECT coalesce(a.p_partkey, b.p_partkey - 1) AS id, coalesce(a.session, b.session) AS session, coalesce(a.field, b.field) AS field, a.v AS t, b.v AS g FROM f a FULL JOIN f b ON b.p_partkey = a.p_partkey + 1 AND a.field = b.field),
c AS (SELECT id, session, field, nullif(CASE WHEN lower(trim(t)) IN ('unknown', 'none', 'no') THEN '' ELSE lower(trim(t)) END, '') AS t, nullif(CASE WHEN lower(trim(g)) IN ('unknown', 'none', 'no') THEN '' ELSE lower(trim(g)) END, '') AS g FROM p),
s AS (SELECT *, """ + DICE_SQL.format(a="regexp_extract_all(t, '[a-z0-9]+')", b="regexp_extract_all(g, '[a-z0-9]+')") + """::DOUBLE AS s FROM c),
o AS (SELECT id, session, field, t, g, CASE WHEN t IS NOT NULL AND g IS NOT NULL THEN s ELSE 0 END AS tp, CASE WHEN t IS NOT NULL AND g IS NOT NULL THEN 1 - s ELSE 0 END AS fp,
CASE WHEN t IS NOT NULL AND g IS NOT NULL THEN 1 - s WHEN t IS NOT NULL THEN 1 ELSE 0 END AS fn, (t IS NULL AND g IS NOT NULL)::INT AS n_fab, (g IS NOT NULL)::INT AS n_gen, coalesce(t = g, false)::INT AS exact, (t IS NOT NULL)::INT AS n_truth FROM s)"""
MICRO_SQL = "round(sum(tp) / (sum(tp) + sum(fp)), 6) AS p, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS r, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1, round(sum(n_fab) / greatest(sum(n_gen), 1), 6) AS fabrication"


def attribute_rows(t):
    name = F.when(F.col("p_size") % 9 == 0, "unknown").otherwise(F.col("p_name"))
    kind = F.when(F.col("p_type") == "ECONOMY", " None ").otherwise(F.col("p_type"))
    return t.part.select("p_partkey", F.col("p_brand").alias("session"), name.alias("name"), kind.alias("type")).unpivot(["p_partkey", "session"], ["name", "type"], "field", "v")


def attribute_pairs(t):
    """Two-sided: the last part's fields have no generation, the first one's stand in for no truth."""
    f = attribute_rows(t).select(F.col("p_partkey").alias("id"), "session", "field", F.array("v").alias("values"))
    return M.field_pairs(f, f.withColumn("id", F.col("id") - 1), "id", extra=["session"])


def outcomes(t):
    return M.attribute_outcomes(attribute_pairs(t))


@query("joi_14_field_outcomes", f"WITH {PAIRS_SQL} SELECT id, field, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn, n_fab, n_gen FROM o")
def _(t):
    return outcomes(t).select("id", "field", F.round("tp", 6).alias("tp"), F.round("fp", 6).alias("fp"), F.round("fn", 6).alias("fn"), "n_fab", "n_gen")


@query("agg_7_hard_micro", f"""WITH {PAIRS_SQL} SELECT round(sum(exact) / sum((n_truth = 1 AND n_gen = 1)::INT), 6) AS p, round(sum(exact) / sum(n_truth), 6) AS r,
round(2 * (sum(exact) / sum((n_truth = 1 AND n_gen = 1)::INT)) * (sum(exact) / sum(n_truth)) / (sum(exact) / sum((n_truth = 1 AND n_gen = 1)::INT) + sum(exact) / sum(n_truth)), 6) AS f1 FROM o""")
def _(t):
    g = outcomes(t).agg(F.sum("exact").alias("e"), F.count_if((F.col("n_truth") == 1) & (F.col("n_gen") == 1)).alias("g"), F.sum("n_truth").alias("t"))
    p, r, f = X.precision_recall_f1(F.col("e"), F.col("g"), F.col("t"))
    return g.select(F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f, 6).alias("f1"))


@query("agg_8_soft_micro", f"WITH {PAIRS_SQL} SELECT {MICRO_SQL} FROM o")
def _(t):
    return M.micro(outcomes(t))


@query("agg_9_per_field", f"WITH {PAIRS_SQL} SELECT field, {MICRO_SQL} FROM o GROUP BY 1 UNION ALL SELECT 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), round(avg(fabrication), 6) FROM (SELECT field, {MICRO_SQL} FROM o GROUP BY 1)")
def _(t):
    per = M.micro(outcomes(t), ["field"])
    macro = per.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("p", "r", "f1", "fabrication")]).select(F.lit("macro").alias("field"), "p", "r", "f1", "fabrication")
    return per.unionByName(macro)


@query("agg_10_fabrication", f"WITH {PAIRS_SQL} SELECT session, sum(n_fab)::BIGINT AS n_fab, sum(n_gen)::BIGINT AS n_gen, round(sum(n_fab) / greatest(sum(n_gen), 1), 6) AS ratio FROM o GROUP BY 1")
def _(t):
    g = outcomes(t).groupBy("session").agg(F.sum("n_fab").alias("n_fab"), F.sum("n_gen").alias("n_gen"))
    return g.withColumn("ratio", F.round(F.col("n_fab") / F.greatest(F.col("n_gen"), F.lit(1)), 6))


JUDGED_SQL = "s2 AS (SELECT *, floor((1 - levenshtein(t, g) / greatest(length(t), length(g))) * 4 + 0.5) / 4 AS j FROM o)"


def judged(a, b):
    """A second scorer in the place of a judge: similarity of characters, snapped to its five levels."""
    return X.snap_score(X.char_similarity(a, b))


@query("agg_11_joint_f1", f"""WITH {PAIRS_SQL}, {JUDGED_SQL}, x AS (SELECT session, sum(tp) AS tp, sum(fp + fn) AS off, sum(CASE WHEN t IS NOT NULL AND g IS NOT NULL THEN j ELSE 0 END) AS jtp, sum(CASE WHEN t IS NOT NULL AND g IS NOT NULL THEN 2 * (1 - j) WHEN t IS NOT NULL THEN 1 ELSE 0 END) AS joff FROM s2 GROUP BY 1),
y AS (SELECT session, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + off) ELSE 0 END AS lexical, CASE WHEN jtp > 0 THEN 2 * jtp / (2 * jtp + joff) ELSE 0 END AS semantic FROM x) SELECT session, round(lexical, 6) AS lexical, round(semantic, 6) AS semantic, round((lexical + semantic) / 2, 6)::DOUBLE AS joint FROM y""")
def _(t):
    """Half the micro F1 of the lexical scorer, half that of the judge; a group without a hit has 0."""
    pairs = attribute_pairs(t)
    part = lambda scorer, name: M.attribute_outcomes(pairs, scorer).groupBy("session").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).select("session", M.f1(F.col("tp"), F.col("fp"), F.col("fn"))[2].alias(name))
    j = part(X.token_dice, "lexical").join(part(judged, "semantic"), "session")
    return j.select("session", F.round("lexical", 6).alias("lexical"), F.round("semantic", 6).alias("semantic"), F.round((F.col("lexical") + F.col("semantic")) / 2, 6).alias("joint"))


@query("agg_12_win_tie_loss", "SELECT count(*) FILTER (a > b) AS win, count(*) FILTER (a = b) AS tie, count(*) FILTER (a < b) AS loss, count(*) FILTER (a > b) - count(*) FILTER (a < b) AS net, round(count(*) FILTER (a > b) / count(*) FILTER (a <> b), 6) AS win_rate FROM (SELECT p_size AS a, lead(p_size) OVER (ORDER BY p_partkey) AS b FROM part) WHERE b IS NOT NULL")
def _(t):
    nxt = t.part.select((F.col("p_partkey") - 1).alias("k"), F.col("p_size").alias("b"))
    j = t.part.select("p_partkey", F.col("p_size").alias("a")).join(nxt, F.col("p_partkey") == F.col("k"))
    return M.win_tie_loss(j, F.col("a"), F.col("b"))


CONF_SQL = "k AS (SELECT l_returnflag || l_linestatus AS truth, CASE WHEN l_quantity > 10 THEN l_returnflag ELSE 'N' END || CASE WHEN l_discount > 0.02 THEN l_linestatus ELSE 'O' END AS pred, count(*) AS n FROM lineitem GROUP BY 1, 2)"
CLASS_SQL = "x AS (SELECT truth AS cls, CASE WHEN truth = pred THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN truth <> pred THEN n ELSE 0 END AS fn FROM k UNION ALL SELECT pred, 0, CASE WHEN truth <> pred THEN n ELSE 0 END, 0 FROM k), y AS (SELECT cls, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM x GROUP BY 1)"


def conf(t):
    pred = F.concat(F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).otherwise("N"), F.when(F.col("l_discount") > 0.02, F.col("l_linestatus")).otherwise("O"))
    return M.confusion(t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("a"), pred.alias("b")), "a", "b")


@query("agg_13_confusion", f"WITH {CONF_SQL} SELECT * FROM k")
def _(t):
    return conf(t)


@query("agg_13_class_metrics", f"WITH {CONF_SQL}, {CLASS_SQL} SELECT cls, tp, fp, fn, round(tp / (tp + fp), 6) AS p, round(tp / (tp + fn), 6) AS r, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS iou FROM y")
def _(t):
    return M.class_metrics(conf(t))


@query("agg_13_macro", f"WITH {CONF_SQL}, {CLASS_SQL}, z AS (SELECT tp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, 2 * tp / (2 * tp + fp + fn) AS f1 FROM y) SELECT round(sum(tp) / sum(tp + fn), 6) AS accuracy, round(avg(round(p, 6)), 6) AS macro_p, round(avg(round(r, 6)), 6) AS macro_r, round(avg(round(f1, 6)), 6) AS macro_f1, count(*) AS classes FROM z")
def _(t):
    return M.accuracy_and_macro(conf(t))


@query("agg_14_segmentation", f"WITH {CONF_SQL}, {CLASS_SQL} SELECT round(avg(round(tp / (tp + fp + fn), 6)), 6) AS miou, round(avg(round(2 * tp / (2 * tp + fp + fn), 6)), 6) AS dice, round(sum(tp) / sum(tp + fn), 6) AS pixel_acc FROM y")
def _(t):
    return M.class_metrics(conf(t)).agg(F.round(F.avg("iou"), 6).alias("miou"), F.round(F.avg("f1"), 6).alias("dice"), F.round(F.sum("tp") / F.sum(F.col("tp") + F.col("fn")), 6).alias("pixel_acc"))


@query("agg_14_kappa", f"WITH {CONF_SQL}, r AS (SELECT truth AS c, sum(n) AS a FROM k GROUP BY 1), q AS (SELECT pred AS c, sum(n) AS b FROM k GROUP BY 1), n AS (SELECT sum(n)::DOUBLE AS n, sum(n) FILTER (truth = pred) AS hit FROM k), e AS (SELECT sum(a::DOUBLE * b) AS e FROM r JOIN q USING (c)) SELECT round(hit / n, 6) AS accuracy, round((hit / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa FROM n, e")
def _(t):
    return M.kappa(conf(t))


@query("agg_14_per_image", """WITH k AS (SELECT l_orderkey AS image, l_returnflag || l_linestatus AS truth, CASE WHEN l_quantity > 10 THEN l_returnflag ELSE 'N' END || CASE WHEN l_discount > 0.02 THEN l_linestatus ELSE 'O' END AS pred, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
x AS (SELECT image, truth AS cls, CASE WHEN truth = pred THEN n ELSE 0 END AS tp, n AS u FROM k UNION ALL SELECT image, pred, 0, n FROM k WHERE truth <> pred),
y AS (SELECT image, cls, sum(tp) / sum(u) AS iou FROM x GROUP BY 1, 2), m AS (SELECT image, round(avg(iou), 6) AS miou FROM y GROUP BY 1)
SELECT image, miou, accuracy FROM m JOIN (SELECT image, round(coalesce(sum(n) FILTER (truth = pred), 0) / sum(n), 6) AS accuracy FROM k GROUP BY 1) USING (image)""")
def _(t):
    """An order as an image, its line items as pixels."""
    pred = F.concat(F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).otherwise("N"), F.when(F.col("l_discount") > 0.02, F.col("l_linestatus")).otherwise("O"))
    conf = t.lineitem.groupBy(F.col("l_orderkey").alias("image"), F.concat("l_returnflag", "l_linestatus").alias("truth"), pred.alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return M.image_metrics(conf, "image")


PURITY_SQL = "c AS (SELECT l_orderkey AS roi, l_returnflag || l_linestatus AS colour, sum(l_quantity) AS px FROM lineitem GROUP BY 1, 2), q AS (SELECT roi, px, px / sum(px) OVER (PARTITION BY roi) AS ratio, sum(px) OVER (PARTITION BY roi) AS total, row_number() OVER (PARTITION BY roi ORDER BY px DESC, colour) AS rk FROM c), u AS (SELECT roi, any_value(total) AS px, max(ratio) FILTER (rk = 1) AS main, coalesce(max(ratio) FILTER (rk = 2), 0) AS second, coalesce(sum(ratio) FILTER (rk > 1), 0) AS minor, count(*) FILTER (ratio >= 0.05) AS effective FROM q GROUP BY 1)"


def purity(t):
    """A line item's flag and status as the colour of l_quantity pixels of an order (the region)."""
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("roi"), F.concat("l_returnflag", "l_linestatus").alias("colour")).agg(F.sum("l_quantity").alias("px"))
    w = W.partitionBy("roi")
    q = c.select("roi", (F.col("px") / F.sum("px").over(w)).alias("ratio"), F.sum("px").over(w).alias("total"), F.row_number().over(w.orderBy(F.desc("px"), "colour")).alias("rk"))
    return q.groupBy("roi").agg(F.first("total").alias("px"), F.max(F.when(F.col("rk") == 1, F.col("ratio"))).alias("main"), F.coalesce(F.max(F.when(F.col("rk") == 2, F.col("ratio"))), F.lit(0.0)).alias("second"),
                                F.coalesce(F.sum(F.when(F.col("rk") > 1, F.col("ratio"))), F.lit(0.0)).alias("minor"), F.count_if(F.col("ratio") >= 0.05).alias("effective"))


@query("agg_15_colour_purity", f"WITH {PURITY_SQL} SELECT roi, px, round(main, 6) AS main, round(second, 6) AS second, round(minor, 6) AS minor, effective FROM u")
def _(t):
    return purity(t).select("roi", "px", F.round("main", 6).alias("main"), F.round("second", 6).alias("second"), F.round("minor", 6).alias("minor"), "effective")


@query("fil_7_pure_colour_gate", f"WITH {PURITY_SQL} SELECT CASE WHEN px < 50 THEN 'reject' WHEN main >= 0.8 AND second <= 0.1 AND minor <= 0.2 THEN 'pure' ELSE 'multi' END AS verdict, count(*) AS n FROM u GROUP BY 1")
def _(t):
    v = F.when(F.col("px") < 50, "reject").when((F.col("main") >= 0.8) & (F.col("second") <= 0.1) & (F.col("minor") <= 0.2), "pure").otherwise("multi")
    return purity(t).groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


LAB_SQL = """p AS (SELECT l_suppkey % 20 AS roi, l_quantity * 5 AS r, l_discount * 2550 AS g, l_tax * 3100 AS b FROM lineitem),
l AS (SELECT roi, list_transform([r, g, b], lambda c: CASE WHEN least(greatest(c, 0), 255) / 255 <= 0.04045 THEN least(greatest(c, 0), 255) / 255 / 12.92 ELSE pow((least(greatest(c, 0), 255) / 255 + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END) AS c FROM p),
x AS (SELECT roi, list_transform([(c[1] * 0.4124564::DOUBLE + c[2] * 0.3575761::DOUBLE + c[3] * 0.1804375::DOUBLE) / 0.95047::DOUBLE, c[1] * 0.2126729::DOUBLE + c[2] * 0.7151522::DOUBLE + c[3] * 0.0721750::DOUBLE, (c[1] * 0.0193339::DOUBLE + c[2] * 0.1191920::DOUBLE + c[3] * 0.9503041::DOUBLE) / 1.08883::DOUBLE],
  lambda t: CASE WHEN t > 216.0::DOUBLE / 24389.0::DOUBLE THEN pow(t, 1.0::DOUBLE / 3.0::DOUBLE) ELSE (t * (24389.0::DOUBLE / 27.0::DOUBLE) + 16) / 116 END) AS f FROM l),
h AS (SELECT roi, least(greatest(floor((round(500 * (f[1] - f[2]), 9) + 128) * 0.5), 0), 127)::BIGINT AS a, least(greatest(floor((round(200 * (f[2] - f[3]), 9) + 128) * 0.5), 0), 127)::BIGINT AS b, count(*) AS n FROM x GROUP BY 1, 2, 3)"""
PEAK_SQL = LAB_SQL + """, d AS (SELECT * FROM range(-1, 2) i(da), range(-1, 2) j(db)), s AS (SELECT roi, a + da AS a, b + db AS b, sum(n * CASE abs(da) + abs(db) WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS s FROM h, d GROUP BY 1, 2, 3),
top AS (SELECT x.roi, x.a, x.b, x.s FROM s x WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.roi = x.roi AND abs(y.a - x.a) <= 1 AND abs(y.b - x.b) <= 1 AND (y.s > x.s OR (y.s = x.s AND (y.a, y.b) < (x.a, x.b))))),
peaks AS (SELECT x.* FROM top x WHERE NOT EXISTS (SELECT 1 FROM top y WHERE y.roi = x.roi AND abs(y.a - x.a) <= 4 AND abs(y.b - x.b) <= 4 AND (y.s > x.s OR (y.s = x.s AND (y.a, y.b) < (x.a, x.b)))))"""


def pixels(t):
    """Line items as pixels of 20 regions."""
    return t.lineitem.select((F.col("l_suppkey") % 20).alias("roi"), (F.col("l_quantity") * 5).alias("r"), (F.col("l_discount") * 2550).alias("g"), (F.col("l_tax") * 3100).alias("b"))


@query("prj_13_histogram_peaks", f"WITH {PEAK_SQL} SELECT roi, a, b, s FROM peaks")
def _(t):
    return colours.peaks(colours.ab_histogram(pixels(t)))


@query("prj_13_purity", f"""WITH {PEAK_SQL}, m AS (SELECT roi, arg_max({{'a': a, 'b': b}}, (s, -a, -b)) AS p, count(*) AS peaks FROM peaks GROUP BY 1)
SELECT h.roi, any_value(peaks) AS peaks, round(sum(n) FILTER (abs(a - p.a) <= 4 AND abs(b - p.b) <= 4) / sum(n), 6) AS purity, (any_value(peaks) <= 1 OR sum(n) FILTER (abs(a - p.a) <= 4 AND abs(b - p.b) <= 4) / sum(n) > 0.85) AS pure FROM h JOIN m ON m.roi = h.roi GROUP BY 1""")
def _(t):
    """Purity: the share of pixels within reach of the highest peak; pure if there is one peak or it holds most."""
    g = colours.purity(colours.ab_histogram(pixels(t)))
    return g.select("roi", "peaks", F.round("u", 6).alias("purity"), ((F.col("peaks") <= 1) | (F.col("u") > 0.85)).alias("pure"))


# Orders as pixels of 50 regions: five colours and greys, each in four lights. Bins are coarse, with lightness (116 * fy - 16).
PALETTE = ((200, 30, 30), (30, 30, 200), (30, 160, 60), (230, 220, 60), (20, 20, 20))
PALETTE_SQL = "pal(colour, r, g, b) AS (VALUES " + ", ".join(str((i, *p)) for i, p in enumerate(PALETTE)) + ")"
CLUSTER_SQL = f"""{PALETTE_SQL}, sh AS (SELECT o_custkey % 50 AS roi, ascii(o_orderpriority) % 5 AS colour, o_orderstatus = 'P' AS grey, (20 - 3 * (o_orderkey % 4)) / 20.0::DOUBLE AS light, 255 - 75 * (o_orderkey % 4) AS level FROM orders),
p AS (SELECT roi, (CASE WHEN grey THEN level ELSE r * light END)::DOUBLE AS r, (CASE WHEN grey THEN level ELSE g * light END)::DOUBLE AS g, (CASE WHEN grey THEN level ELSE b * light END)::DOUBLE AS b FROM sh JOIN pal USING (colour)),""" + LAB_SQL[LAB_SQL.index("l AS (SELECT roi") : LAB_SQL.index("h AS (")] + """q AS (SELECT roi, least(greatest(floor(round(116 * f[2] - 16, 9) * 0.08::DOUBLE), 0), 7)::BIGINT AS l, least(greatest(floor((round(500 * (f[1] - f[2]), 9) + 128) * 0.125), 0), 31)::BIGINT AS a,
  least(greatest(floor((round(200 * (f[2] - f[3]), 9) + 128) * 0.125), 0), 31)::BIGINT AS b FROM x),
k AS (SELECT roi, (l * 32 + a) * 32 + b AS cluster, l, a, b, count(*) AS n FROM q GROUP BY ALL),
z AS MATERIALIZED (SELECT *, sqrt(pow((a + 0.5) * 8 - 128, 2) + pow((b + 0.5) * 8 - 128, 2)) < 10 AS neutral, round((degrees(atan2((b + 0.5) * 8 - 128, (a + 0.5) * 8 - 128)) + 360) % 360, 9) AS hue FROM k)"""


def palette(colour):
    return F.element_at(F.array(*[F.struct(*[F.lit(float(v)).alias(c) for c, v in zip("rgb", p, strict=True)]) for p in PALETTE]), colour.cast("int") + 1)


@query("prj_14_shadow_merge", f"""WITH RECURSIVE {CLUSTER_SQL}, e AS MATERIALIZED (SELECT x.roi, x.cluster AS u, y.cluster AS v FROM z x JOIN z y ON x.roi = y.roi AND x.cluster <> y.cluster AND x.neutral = y.neutral WHERE CASE WHEN x.neutral THEN x.l = y.l
  ELSE abs(x.a - y.a) <= 2 AND abs(x.b - y.b) <= 2 AND least(abs(x.hue - y.hue), 360 - abs(x.hue - y.hue)) <= 15 END),
w AS (SELECT roi, cluster AS u, cluster AS v FROM z UNION SELECT w.roi, w.u, e.v FROM w JOIN e ON e.roi = w.roi AND e.u = w.v), c AS (SELECT roi, u AS cluster, min(v) AS colour FROM w GROUP BY 1, 2),
g AS (SELECT roi, colour, any_value(neutral) AS neutral, count(*) AS members, sum(n)::BIGINT AS n FROM z JOIN c USING (roi, cluster) GROUP BY 1, 2)
SELECT roi, colour, CASE WHEN neutral THEN 'neutral' ELSE 'chromatic' END AS kind, members, n, round(n / sum(n) OVER (PARTITION BY roi), 6) AS share FROM g""")
def _(t):
    """One colour in light and in shadow counts once; black, grey and white stay apart."""
    grey, at = F.col("o_orderstatus") == "P", F.pmod("o_orderkey", F.lit(4))
    light, level = (20 - 3 * at) / 20.0, (255 - 75 * at).cast("double")
    rows = t.orders.select(F.pmod("o_custkey", F.lit(50)).alias("roi"), palette(F.pmod(F.ascii("o_orderpriority"), F.lit(5))).alias("p"), grey.alias("grey"), light.alias("light"), level.alias("level"))
    shaded = rows.select("roi", *[F.when(F.col("grey"), F.col("level")).otherwise(F.col(f"p.{c}") * F.col("light")).alias(c) for c in "rgb"])
    return colours.shadow_merge(colours.colour_clusters(shaded))


# Orders as pixels of regions of 16 by 16: plain, striped, checked, or coloured by what the order is.
GRID_SQL = """gp AS (SELECT o_orderkey // 256 AS roi, (o_orderkey // 16) % 16 AS y, o_orderkey % 16 AS x, CASE (o_orderkey // 256) % 4 WHEN 0 THEN 0 WHEN 1 THEN (o_orderkey % 16) // 3 % 2 WHEN 2 THEN (o_orderkey % 16) // 2 % 2 + 2 * ((o_orderkey // 16) % 16 // 4 % 2)
  ELSE ascii(o_orderpriority) % 5 END::BIGINT AS colour FROM orders), """ + PALETTE_SQL


def _axis_sql(line: str, along: str) -> str:
    """Runs by a change flag and its running sum; the most common inner length, the shorter of equal ones."""
    return f"""{along}1 AS (SELECT *, coalesce((colour <> lag(colour) OVER o)::INT, 1) AS c FROM gp WINDOW o AS (PARTITION BY roi, {line} ORDER BY {along})),
{along}2 AS (SELECT roi, {line}, run, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY roi, {line} ORDER BY {along}) AS run FROM {along}1) GROUP BY 1, 2, 3),
{along}3 AS (SELECT roi, n, run > 1 AND run < max(run) OVER (PARTITION BY roi, {line}) AS inside FROM {along}2), {along}4 AS (SELECT roi, n, count(*) FILTER (inside) AS k, count(*) AS m FROM {along}3 GROUP BY 1, 2),
{along}5 AS (SELECT roi, sum(m) AS m, sum(k) AS k, max(k) AS best, arg_max(n, (k, -n)) AS length FROM {along}4 GROUP BY 1),
{along}6 AS (SELECT roi, round(m / lines - 1, 6) AS {along}_changes, CASE WHEN k > 0 THEN 2 * length END AS {along}_period, round(CASE WHEN k > 0 THEN best / k ELSE 0 END, 6) AS {along}_regular FROM {along}5 JOIN (SELECT roi, count(DISTINCT {line}) AS lines FROM gp GROUP BY 1) USING (roi))"""


TEXTURE_SQL = f"""{GRID_SQL}, {_axis_sql('y', 'x')}, {_axis_sql('x', 'y')}, tx AS (SELECT roi, x_changes, x_period, x_regular, y_changes, y_period, y_regular, CASE WHEN x_changes < 0.5 AND y_changes < 0.5 THEN 'plain' WHEN x_changes >= 0.5 AND x_regular >= 0.75 AND x_period >= 4 AND y_changes >= 0.5 AND y_regular >= 0.75 AND y_period >= 4 THEN 'plaid'
WHEN (x_changes >= 0.5 AND x_regular >= 0.75 AND x_period >= 4 AND y_changes < 0.5) OR (y_changes >= 0.5 AND y_regular >= 0.75 AND y_period >= 4 AND x_changes < 0.5) THEN 'stripe' ELSE 'mixed' END AS texture FROM x6 JOIN y6 USING (roi))"""


def grid(t):
    key = F.col("o_orderkey")
    roi, y, x = F.floor(key / 256), F.pmod(F.floor(key / 16), F.lit(16)), F.pmod(key, F.lit(16))
    check = F.pmod(F.floor(x / 2), F.lit(2)) + 2 * F.pmod(F.floor(y / 4), F.lit(2))
    kind = F.pmod(roi, F.lit(4))
    colour = F.when(kind == 0, 0).when(kind == 1, F.pmod(F.floor(x / 3), F.lit(2))).when(kind == 2, check).otherwise(F.pmod(F.ascii("o_orderpriority"), F.lit(5))).cast("long")
    return t.orders.select(roi.alias("roi"), y.alias("y"), x.alias("x"), colour.alias("colour"), palette(colour).alias("p")).select("roi", "y", "x", "colour", "p.*")


@query("win_11_textures", f"WITH {TEXTURE_SQL} SELECT * FROM tx")
def _(t):
    """Stripes and plaids by the lengths of runs along rows and columns."""
    return colours.textures(grid(t))


@query("fil_8_peak_gate", f"""WITH {TEXTURE_SQL}, {PEAK_SQL.replace(PEAK_SQL[: PEAK_SQL.index("l AS (SELECT roi")], "p AS (SELECT roi, r, g, b FROM gp JOIN pal USING (colour))," + chr(10))}, m AS (SELECT roi, arg_max({{'a': a, 'b': b}}, (s, -a, -b)) AS p, count(*) AS peaks FROM peaks GROUP BY 1),
u AS (SELECT h.roi, any_value(peaks) AS peaks, sum(n) FILTER (abs(a - p.a) <= 4 AND abs(b - p.b) <= 4) / sum(n) AS u FROM h JOIN m ON m.roi = h.roi GROUP BY 1)
SELECT roi, peaks, round(u, 6) AS purity, texture, CASE WHEN peaks <= 1 OR u > 0.85 THEN 'pure' ELSE 'multi' END AS verdict, CASE WHEN peaks <= 1 OR u > 0.85 THEN 0 WHEN texture IN ('stripe', 'plaid') THEN 0.3 ELSE 0.6 END::DOUBLE AS penalty FROM u JOIN tx USING (roi)""")
def _(t):
    """Pure by peaks and purity; the penalty of many colours depends on the texture."""
    return colours.peak_gate(grid(t))


@query("prj_12_weighted_similarity", "SELECT a.p_partkey, round(0.5 * (a.p_type = b.p_type)::INT + 0.3 * (a.p_brand = b.p_brand)::INT + 0.2 * (1 - abs(a.p_size - b.p_size) / 50), 6)::DOUBLE AS score FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(t):
    b = t.part.select((F.col("p_partkey") - 1).alias("k"), *[F.col(c).alias(f"o_{c}") for c in ("p_type", "p_brand", "p_size")])
    j = t.part.join(b, F.col("p_partkey") == F.col("k"))
    same = lambda c: (F.col(c) == F.col(f"o_{c}")).cast("int")
    return j.select("p_partkey", F.round(0.5 * same("p_type") + 0.3 * same("p_brand") + 0.2 * (1 - F.abs(F.col("p_size") - F.col("o_p_size")) / 50), 6).alias("score"))


@query("fil_15_loc_echo", "SELECT p_partkey FROM part WHERE p_size BETWEEN 0 AND 999 AND p_partkey % 1200 <= 999 AND p_partkey % 3 <> 0")
def _(t):
    echoed = F.concat(F.lit("<loc_"), "p_size", F.lit("><loc_"), F.col("p_partkey") % 1200, F.lit("><loc_3>"), F.when(F.col("p_partkey") % 3 != 0, "<loc_4>").otherwise(""))
    loc = X.loc_tokens(echoed)
    asked = F.array(F.col("p_size"), (F.col("p_partkey") % 1200).cast("int"), F.lit(3), F.lit(4))
    return t.part.where((F.size(loc) == 4) & F.forall(loc, lambda x: (x >= 0) & (x <= 999)) & (loc == asked)).select("p_partkey")


@query("agg_20_text_quality", f"""WITH p AS (SELECT q.*, role FROM ({TURNS_SQL}) q JOIN conversations USING (conv_id, turn)), a AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS w FROM p) GROUP BY 1, 2, 3),
b AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(y), '[a-z0-9]+')) AS w FROM p) GROUP BY 1, 2, 3),
s AS (SELECT conv_id, turn, sum(least(a.n, b.n)) AS s FROM a JOIN b USING (conv_id, turn, w) GROUP BY 1, 2),
n AS (SELECT role, length(x) AS cx, length(y) AS cy, coalesce(s, 0) AS s, len(regexp_extract_all(lower(x), '[a-z0-9]+')) AS g, len(regexp_extract_all(lower(y), '[a-z0-9]+')) AS t FROM p LEFT JOIN s USING (conv_id, turn))
SELECT role, count(*) AS n, round(avg(CASE WHEN g > 0 THEN s / g ELSE 0 END), 6) AS p, round(avg(CASE WHEN t > 0 THEN s / t ELSE 0 END), 6) AS r, round(avg(CASE WHEN s > 0 THEN 2 * (s / g) * (s / t) / (s / g + s / t) ELSE 0 END), 6) AS f1,
round(avg(cx), 6) AS chars, round(avg(cy), 6) AS ref_chars, round(avg(g), 6) AS tokens, round(avg(t), 6) AS ref_tokens FROM n GROUP BY 1""")
def _(t):
    """A turn as the generated text, the next one as its reference; means by the role of the turn."""
    rows = turns(t).join(t.conversations.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    rows = rows.select("conv_id", "turn", "role", F.length("x").alias("cx"), F.length("y").alias("cy"), X.tokens(F.col("x")).alias("a"), X.tokens(F.col("y")).alias("b"))
    p, r, f = X.precision_recall_f1(F.col("shared").cast("double"), F.col("n_a"), F.col("n_b"))
    j = M.token_overlap(rows, ["conv_id", "turn"], "a", "b", ["role", "cx", "cy"]).select("role", "cx", "cy", p.alias("p"), r.alias("r"), f.alias("f1"), "n_a", "n_b")
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return j.groupBy("role").agg(F.count(F.lit(1)).alias("n"), mean("p", "p"), mean("r", "r"), mean("f1", "f1"), mean("cx", "chars"), mean("cy", "ref_chars"), mean("n_a", "tokens"), mean("n_b", "ref_tokens"))


@query("agg_20_rouge_l", f"WITH {ROUGE_SQL} SELECT role, count(*) AS n, round(avg(l), 6) AS rouge_l FROM r GROUP BY 1")
def _(t):
    """ROUGE-L of tokens by the role of the turn."""
    rows = turns(t).select("conv_id", "turn", X.rouge_l(X.tokens(F.col("x")), X.tokens(F.col("y"))).alias("l")).join(t.conversations.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l"), 6).alias("rouge_l"))


@query("agg_20_sequence_quality")
def _(t):
    """ROUGE-L of tokens and similarity of characters; DuckDB's edit distance counts bytes, so the second has no SQL."""
    rows = turns(t).select("conv_id", "turn", X.rouge_l(X.tokens(F.col("x")), X.tokens(F.col("y"))).alias("l"), X.char_similarity(F.col("x"), F.col("y")).alias("c"))
    j = rows.join(t.conversations.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return j.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l"), 6).alias("rouge_l"), F.round(F.avg("c"), 6).alias("char_similarity"))


@query("run_6_rescore", f"WITH {PAIRS_SQL}, e AS (SELECT session, CASE WHEN t IS NOT NULL AND g IS NOT NULL THEN exact ELSE 0 END AS tp, CASE WHEN t IS NOT NULL AND g IS NOT NULL THEN 1 - exact ELSE 0 END AS fp, CASE WHEN t IS NOT NULL AND g IS NOT NULL THEN 1 - exact WHEN t IS NOT NULL THEN 1 ELSE 0 END AS fn, n_fab, n_gen FROM o) SELECT session, 'dice' AS scorer, coalesce({MICRO_SQL.replace(' AS p,', ', 0) AS p, coalesce(').replace(' AS r,', ', 0) AS r, coalesce(').replace(' AS f1,', ', 0) AS f1,')} FROM o GROUP BY 1 UNION ALL SELECT session, 'exact', coalesce({MICRO_SQL.replace(' AS p,', ', 0) AS p, coalesce(').replace(' AS r,', ', 0) AS r, coalesce(').replace(' AS f1,', ', 0) AS f1,')} FROM e GROUP BY 1")
def _(t):
    """Stored predictions under two scorers: scoring is a function of two tables, no model runs again."""
    stored = attribute_pairs(t)
    return M.rescore(stored, ["session"], {"dice": X.token_dice, "exact": lambda a, b: (a == b).cast("double")})


# Two candidates for the same truth: the base's values are the next part's; the other candidate has the own ones for parts of even size.
CANDIDATE_SQL = PAIRS_SQL + """, o2 AS (SELECT o.*, CASE WHEN t IS NULL THEN g WHEN p_size % 2 = 0 THEN t ELSE g END AS g2 FROM o LEFT JOIN part ON p_partkey = id),
c2 AS (SELECT *, """ + DICE_SQL.format(a="regexp_extract_all(t, '[a-z0-9]+')", b="regexp_extract_all(g2, '[a-z0-9]+')") + """::DOUBLE AS s2 FROM o2),
st AS (SELECT session, sum(tp) AS tp_a, sum(fp) AS fp_a, sum(fn) AS fn_a, sum(CASE WHEN t IS NOT NULL AND g2 IS NOT NULL THEN s2 ELSE 0 END) AS tp_b, sum(CASE WHEN t IS NOT NULL AND g2 IS NOT NULL THEN 1 - s2 ELSE 0 END) AS fp_b,
sum(CASE WHEN t IS NOT NULL AND g2 IS NOT NULL THEN 1 - s2 WHEN t IS NOT NULL THEN 1 ELSE 0 END) AS fn_b FROM c2 GROUP BY 1)"""
F1_DIFF_SQL = "2 * sum(tp_b) / (2 * sum(tp_b) + sum(fp_b) + sum(fn_b)) - 2 * sum(tp_a) / (2 * sum(tp_a) + sum(fp_a) + sum(fn_a))"
BOOT_SQL = f"""{CANDIDATE_SQL}, rk AS (SELECT *, row_number() OVER (ORDER BY session) - 1 AS rank, count(*) OVER () AS n FROM st),
d AS (SELECT rep, (('0x' || substr(md5('boot|' || rep || '|' || draw), 1, 8))::BIGINT * n) >> 32 AS rank FROM (SELECT DISTINCT n FROM rk), range(2000) r(rep), range((SELECT count(*) FROM st)) i(draw)),
v AS (SELECT rep, {F1_DIFF_SQL} AS f1_diff, sum(fp_b) - sum(fp_a) AS fp_diff FROM d JOIN rk USING (rank) GROUP BY 1), pt AS (SELECT {F1_DIFF_SQL} AS f1_diff, sum(fp_b) - sum(fp_a) AS fp_diff FROM st)"""
BOOT_SUMS = ["tp_a", "fp_a", "fn_a", "tp_b", "fp_b", "fn_b"]


def candidate_sums(t):
    """tp, fp, fn of the base (a) and the other candidate (b) by session."""
    pairs = attribute_pairs(t).join(t.part.select(F.col("p_partkey").alias("id"), "p_size"), "id", "left")
    other = F.when(F.col("truth").isNull(), F.col("gen")).when(F.col("p_size") % 2 == 0, F.col("truth")[0]).otherwise(F.col("gen"))
    part = lambda rows, x: M.attribute_outcomes(rows).groupBy("session").agg(*[F.sum(c).alias(f"{c}_{x}") for c in ("tp", "fp", "fn")])
    return part(pairs, "a").join(part(pairs.withColumn("gen", other), "b"), "session")


def f1_difference(c):
    return M.soft_f1(c["tp_b"], c["fp_b"], c["fn_b"]) - M.soft_f1(c["tp_a"], c["fp_a"], c["fn_a"])


@query("agg_21_clustered_bootstrap", f"""WITH {BOOT_SQL} SELECT 'f1_diff' AS statistic, round((SELECT f1_diff FROM pt), 6) AS point, round(quantile_cont(f1_diff, 0.025), 6) AS low, round(quantile_cont(f1_diff, 0.975), 6) AS high, count(*) AS reps FROM v
UNION ALL SELECT 'fp_diff', round((SELECT fp_diff FROM pt), 6), round(quantile_cont(fp_diff, 0.025), 6), round(quantile_cont(fp_diff, 0.975), 6), count(*) FROM v""")
def _(t):
    """Paired differences of two candidates: whole sessions drawn with replacement, 2,000 times."""
    return M.paired_bootstrap(candidate_sums(t), "session", BOOT_SUMS, {"f1_diff": f1_difference, "fp_diff": lambda c: c["fp_b"] - c["fp_a"]})


@query("agg_22_spearman", """WITH r AS (SELECT l_quantity, l_extendedprice, (rank() OVER (ORDER BY l_quantity) + rank() OVER (ORDER BY l_quantity) + count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS ra,
(rank() OVER (ORDER BY l_extendedprice) + rank() OVER (ORDER BY l_extendedprice) + count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS rb FROM lineitem) SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r""")
def _(t):
    return M.spearman(t.lineitem, "l_quantity", "l_extendedprice")


@query("arr_2_greedy_extras", """WITH RECURSIVE p AS (SELECT a.p_partkey, [a.p_name, a.p_brand, a.p_type] AS truth, [b.p_name, b.p_brand] AS gen FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
m AS (SELECT p_partkey, i, j, """ + DICE_SQL.format(a="regexp_extract_all(lower(gen[i]), '[a-z0-9]+')", b="regexp_extract_all(lower(truth[j]), '[a-z0-9]+')") + """::DOUBLE AS s FROM p, range(1, 3) x(i), range(1, 4) y(j)),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, i, j) AS rk FROM m WHERE s >= 0.5),
g AS (SELECT p_partkey, 0::BIGINT AS rk, []::BIGINT[] AS ui, []::BIGINT[] AS uj, 0.0::DOUBLE AS soft FROM p UNION ALL
SELECT g.p_partkey, o.rk, CASE WHEN free THEN list_append(ui, o.i) ELSE ui END, CASE WHEN free THEN list_append(uj, o.j) ELSE uj END, CASE WHEN free THEN soft + o.s ELSE soft END FROM (SELECT g.*, o.i, o.j, o.s, o.rk AS ork, NOT list_contains(ui, o.i) AND NOT list_contains(uj, o.j) AS free FROM g JOIN o ON o.p_partkey = g.p_partkey AND o.rk = g.rk + 1) g JOIN o ON o.p_partkey = g.p_partkey AND o.rk = ork),
l AS (SELECT p_partkey, arg_max(ui, rk) AS ui, arg_max(uj, rk) AS uj, arg_max(soft, rk) AS soft FROM g GROUP BY 1) SELECT p_partkey, round(soft, 6) AS soft, len(ui)::INT AS hits, (2 - len(ui))::INT AS n_fab, (3 - len(uj))::INT AS fn FROM l""")
def _(t):
    truth = t.part.select("p_partkey", F.array("p_name", "p_brand", "p_type").alias("truth"))
    gen = t.part.select((F.col("p_partkey") - 1).alias("k"), F.array("p_name", "p_brand").alias("gen"))
    return truth.join(gen, F.col("p_partkey") == F.col("k")).select("p_partkey", M.greedy_extras(F.col("truth"), F.col("gen")).alias("m")).select("p_partkey", "m.*")


@query("snk_4_scored_samples", f"WITH {PAIRS_SQL} SELECT id, session, 'soft' AS candidate, round(CASE WHEN sum(tp) > 0 THEN 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0 END, 6) AS f1, sum(n_gen)::BIGINT AS n_gen_assert, sum(n_fab)::BIGINT AS n_fab FROM o GROUP BY 1, 2")
def _(t):
    g = outcomes(t).groupBy("id", "session").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("n_gen").alias("n_gen_assert"), F.sum("n_fab").alias("n_fab"))
    return g.select("id", "session", F.lit("soft").alias("candidate"), F.round(M.f1(F.col("tp"), F.col("fp"), F.col("fn"))[2], 6).alias("f1"), "n_gen_assert", "n_fab")
