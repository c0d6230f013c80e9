"""Scoring of generated attributes, classes and pixels against references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.session import checkpointed, with_prefix


def attribute_outcomes(pairs: DataFrame, similarity: Callable[[Column, Column], Column] = X.token_dice) -> DataFrame:
    """Adds tp, fp, fn, n_fab, n_gen, exact to rows with ``truth`` (array) and ``gen`` (string).

    Both absent: nothing. Truth absent, a concrete value generated: fabrication, outside of F1.
    Truth present, nothing generated: fn 1. Both: similarity s (list truth by its best element)
    gives tp s, fp and fn 1 - s.
    """
    truth, gen = X.normalise_values(F.col("truth")), X.present(F.col("gen"))
    rows = pairs.withColumn("_t", F.coalesce(truth, F.array().cast("array<string>"))).withColumn("_g", gen)
    has_t, has_g = F.size("_t") > 0, F.col("_g").isNotNull()
    s = X.best_element(F.col("_t"), F.col("_g"), similarity)
    rows = rows.withColumn("_s", F.when(has_t & has_g, s))
    zero = F.lit(0.0)
    return rows.select(
        *pairs.columns,
        F.coalesce("_s", zero).alias("tp"),
        F.coalesce(1 - F.col("_s"), zero).alias("fp"),
        F.when(has_t & has_g, 1 - F.col("_s")).when(has_t, F.lit(1.0)).otherwise(zero).alias("fn"),
        (~has_t & has_g).cast("int").alias("n_fab"),
        has_g.cast("int").alias("n_gen"),
        (has_t & has_g & F.array_contains("_t", F.col("_g"))).cast("int").alias("exact"),
        has_t.cast("int").alias("n_truth"),
    )


def f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    return X.precision_recall_f1(tp, tp + fp, tp + fn)


def soft_f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2 tp / (2 tp + fp + fn), 0 without a denominator: the F1 of ``f1`` as one division."""
    below = 2 * tp + fp + fn
    return F.when(below > 0, 2 * tp / below).otherwise(F.lit(0.0))


def micro(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Soft micro precision, recall, F1 and the fabrication ratio, by group or overall."""
    g = outcomes.groupBy(*(by or [])).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("n_fab").alias("fab"), F.sum("n_gen").alias("gen"))
    p, r, f = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.select(*(by or []), F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f, 6).alias("f1"), F.round(F.col("fab") / F.greatest(F.col("gen"), F.lit(1)), 6).alias("fabrication"))


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(conf: DataFrame) -> DataFrame:
    """Per class tp, fp, fn, precision, recall, F1, IoU, dice from (truth, pred, n) rows."""
    long = conf.select(F.explode(F.array(
        F.struct(F.col("truth").alias("cls"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("truth") != F.col("pred"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.when(F.col("truth") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )).alias("x")).select("x.*")
    g = long.groupBy("cls").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    union = F.col("tp") + F.col("fp") + F.col("fn")
    return g.select("cls", "tp", "fp", "fn", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f, 6).alias("f1"), F.round(F.when(union > 0, F.col("tp") / union).otherwise(0.0), 6).alias("iou"))


def kappa(conf: DataFrame) -> DataFrame:
    """Accuracy and Cohen's kappa of (truth, pred, n) rows."""
    total = conf.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    rows, cols = conf.groupBy("truth").agg(F.sum("n").alias("a")), conf.groupBy("pred").agg(F.sum("n").alias("b"))
    chance = rows.join(cols, rows["truth"] == cols["pred"]).agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("c"))
    both = total.join(F.broadcast(chance))  # two rows of one
    n = F.col("n").cast("double")
    pe = F.coalesce("c", F.lit(0.0)) / (n * n)
    return both.select(F.round(F.col("hit") / n, 6).alias("accuracy"), F.round(F.when(pe < 1, (F.col("hit") / n - pe) / (1 - pe)).otherwise(0.0), 6).alias("kappa"))


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean: a rank per distinct value from a distributed prefix sum, joined back."""
    counts = with_prefix(df.groupBy(value).agg(F.count(F.lit(1)).alias("_c")), [value], F.col("_c"), "_below")
    return df.join(counts.select(value, (F.col("_below") + (F.col("_c") + 1) / 2).alias(name)), value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = average_rank(average_rank(df.select(a, b).dropna(), a, "ra"), b, "rb")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("ra", "rb"), 6).alias("rho"))


def win_tie_loss(df: DataFrame, ours: Column, theirs: Column) -> DataFrame:
    w, t, lost = F.count_if(ours > theirs), F.count_if(ours == theirs), F.count_if(ours < theirs)
    return df.agg(w.alias("win"), t.alias("tie"), lost.alias("loss"), (w - lost).alias("net"), F.round(F.when(w + lost > 0, w / (w + lost)).otherwise(0.0), 6).alias("win_rate"))


def token_overlap(rows: DataFrame, key: list[str], a: str, b: str, keep: list[str] | None = None) -> DataFrame:
    """``key``, n_a, n_b, shared of two token arrays, repeats counted, and ``keep``.

    Both texts are in one row, so the row counts what they share, without a shuffle, and costs its
    length, however long. Rows of one key, if there are any, count all their words together.
    """
    keep = keep or []
    sizes = [F.size(a).cast("long").alias("n_a"), F.size(b).cast("long").alias("n_b")]
    alone = lambda r: r.select(*key, *sizes, F.coalesce(X.shared_tokens(F.col(a), F.col(b)), F.lit(0)).cast("long").alias("shared"), *keep)
    names = [f"_k{i}" for i in range(len(key))]
    repeated = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*names)
    repeated = checkpointed(repeated)
    if repeated.isEmpty():
        return alone(rows)
    on = F.lit(True)
    for k, n in zip(key, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    some = rows.join(repeated, on, "left_semi")
    side = lambda c, n, m: some.select(*key, F.explode(c).alias("w"), F.lit(n).cast("long").alias("x"), F.lit(m).cast("long").alias("y"))
    words = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(*key, "w").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    got = words.groupBy(*[F.col(k).alias(n) for k, n in zip(key, names, strict=True)]).agg(F.sum(F.least("x", "y")).alias("shared"))
    together = some.select(*key, *sizes, *keep).join(got, on, "left").select(*key, "n_a", "n_b", F.coalesce("shared", F.lit(0)).cast("long").alias("shared"), *keep)
    return alone(rows.join(repeated, on, "left_anti")).unionByName(together)


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``group`` and one interpolated quantile of ``value`` for each name in ``shares``, exact.

    Equal values are counted first and ranked by a distributed prefix sum, so a group's values never
    meet in one task. Null values don't count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    ranked = with_prefix(counts, ["g", "v"], F.col("c"), "before")
    totals = ranked.groupBy(F.col("g").alias("t_g")).agg(F.sum("c").alias("n"), F.min("before").alias("first"))
    ranked = ranked.join(totals, F.col("g").eqNullSafe(F.col("t_g"))).select("g", "v", "n", (F.col("before") - F.col("first")).alias("low"), (F.col("before") - F.col("first") + F.col("c")).alias("high"))
    out = []
    for name, share in shares.items():
        at = (F.col("n") - 1) * share
        take = lambda k: F.max(F.when((F.col("low") <= k) & (k < F.col("high")), F.col("v")))
        lower, upper = take(F.floor(at)), take(F.ceil(at))
        out.append((lower + (upper - lower) * F.max(at - F.floor(at))).alias(name))
    return ranked.groupBy(F.col("g").alias(group)).agg(*out)


def rescore(stored: DataFrame, by: list[str], scorers: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """Stored predictions (truth, gen) scored anew by each scorer, without new inference: ``by``, scorer, p, r, f1, fabrication."""
    parts = [micro(attribute_outcomes(stored, s), by).withColumn("scorer", F.lit(n)) for n, s in scorers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def image_metrics(conf: DataFrame, image: str) -> DataFrame:
    """Per image mIoU over its classes and pixel accuracy, from (image, truth, pred, n) rows."""
    hit = F.col("truth") == F.col("pred")
    long = conf.select(image, F.col("n"), hit.alias("hit"), F.explode(F.when(hit, F.array("truth")).otherwise(F.array("truth", "pred"))).alias("cls"))
    per = long.groupBy(image, "cls").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("union"))
    miou = per.groupBy(image).agg(F.round(F.avg(F.col("tp") / F.col("union")), 6).alias("miou"))
    acc = conf.groupBy(image).agg(F.round(F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"))
    return miou.join(acc, image)


def paired_bootstrap(stats: DataFrame, cluster: str, sums: list[str], statistics: dict[str, Callable[[dict[str, Column]], Column]], reps: int = 2000, seed: str = "boot") -> DataFrame:
    """(statistic, point, low, high, reps) of functions of summed columns over whole clusters: 2.5% and 97.5% quantiles.

    ``stats`` has one row of sufficient statistics for each cluster; the same draws serve all
    statistics, so differences of candidates are paired. A replicate draws as many clusters as there
    are, with replacement: draw d of replicate r takes the cluster at rank floor(u * clusters), u from
    the md5 of seed, r and d, so every engine draws alike. Draws are joined with ranked clusters and
    summed where they stand: a replicate costs a row for each cluster, not for each sample, and
    nothing is collected.
    """
    spark = stats.sparkSession
    ranked = checkpointed(with_prefix(stats.groupBy(cluster).agg(*[F.sum(c).alias(c) for c in sums]), [cluster], name="rank").withColumn("rank", F.col("rank").cast("long")))
    n = ranked.count()
    point = ranked.agg(*[F.sum(c).alias(c) for c in sums])
    values = lambda: F.explode(F.array(*[F.struct(F.lit(name).alias("statistic"), f({c: F.col(c) for c in sums}).cast("double").alias("value")) for name, f in statistics.items()])).alias("s")
    draws = spark.range(reps * n).select(F.floor(F.col("id") / max(n, 1)).alias("rep"), F.pmod("id", F.lit(max(n, 1))).alias("draw"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("rep").cast("string"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = draws.select("rep", F.shiftright(hashed * n, 32).alias("rank")).join(ranked, "rank")
    per = drawn.groupBy("rep").agg(*[F.sum(c).alias(c) for c in sums]).select(values()).select("s.*")
    spread = per.groupBy("statistic").agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("reps"))
    points = point.select(values()).select(F.col("s.statistic").alias("_s"), F.col("s.value").alias("point"))
    return spread.join(points, F.col("statistic") == F.col("_s")).select("statistic", F.round("point", 6).alias("point"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "reps")


def field_pairs(truth: DataFrame, gen: DataFrame, key: str, field: str = "field", values: str = "values", extra: list[str] | None = None) -> DataFrame:
    """(key, field, truth, gen, extra...): both sides' values of every field that either side has.

    ``truth`` and ``gen`` are long forms with a list of strings; a generated list is one text of its
    elements. A full outer join, null-safe in both keys: a field without a generation has a null
    ``gen`` and will count as a miss, one without truth a null ``truth`` and may be a fabrication.
    ``extra`` columns come from the truth, else from the generation.
    """
    extra = extra or []
    t = truth.select(key, field, F.col(values).alias("truth"), *extra)
    g = gen.select(F.col(key).alias("_k"), F.col(field).alias("_f"), F.array_join(values, " ").alias("gen"), *[F.col(c).alias(f"_{c}") for c in extra], F.lit(True).alias("_g"))
    j = t.withColumn("_t", F.lit(True)).join(g, F.col(key).eqNullSafe(F.col("_k")) & F.col(field).eqNullSafe(F.col("_f")), "full_outer")
    mine = lambda c, other: F.when(F.col("_t"), F.col(c)).otherwise(F.col(other))
    return j.select(mine(key, "_k").alias(key), mine(field, "_f").alias(field), "truth", "gen", *[F.coalesce(c, f"_{c}").alias(c) for c in extra])


def accuracy_and_macro(conf: DataFrame) -> DataFrame:
    """Accuracy, and unweighted means over classes of precision, recall and F1, from (truth, pred, n) rows."""
    per = class_metrics(conf)
    return per.agg(F.round(F.sum("tp") / F.sum(F.col("tp") + F.col("fn")), 6).alias("accuracy"), *[F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("p", "r", "f1")], F.count(F.lit(1)).alias("classes"))


def gate(structure: Column, structure_base: Column, leakage: Column, invalid: Column, invalid_base: Column, delta: Column, low: Column) -> Column:
    """The pre-registered verdict: the first broken rule, or ``pass``."""
    return (
        F.when((structure < 0.95) | (structure - structure_base < -0.01), F.lit("structure"))
        .when(leakage > 0.01, F.lit("leakage"))
        .when(invalid - invalid_base > 0.005, F.lit("invalid"))
        .when((delta <= 0.005) | (low <= 0), F.lit("joint_f1"))
        .otherwise(F.lit("pass"))
    )


def format_rates(rows: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Shares of texts by group: single sentence, subject first, the structure gate (both, and a valid output), background leakage, invalid output, 18 to 24 words."""
    x, n = F.col(text), X.token_count(F.col(text))
    rate = lambda c, name: F.round(F.avg(c.cast("int")), 6).alias(name)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), rate(X.sentence_ends(x) <= 1, "single"), rate(X.subject_first(x), "subject_first"), rate(X.one_sentence(x, X.SUBJECT) & ~X.invalid_output(x), "structure"),
        rate(X.background(x), "leakage"), rate(X.invalid_output(x), "invalid"), rate((n >= 18) & (n <= 24), "in_range"), F.round(F.avg(n), 6).alias("mean_words"))


def keyword_hits(rows: DataFrame, keep: list[str], text: str, keywords: DataFrame, keyword: str) -> DataFrame:
    """``keep`` and each word of the dimension table that the text has, once: an equi-join of words, so Spark broadcasts a small table only."""
    words = rows.select(*keep, F.explode(F.array_distinct(X.tokens(F.col(text)))).alias(keyword))
    return words.join(keywords.select(keyword).distinct(), keyword)


def keyword_counts(rows: DataFrame, by: list[str], text: str, keywords: DataFrame, keyword: str) -> DataFrame:
    """``by``, word of the dimension table and n: how many texts have it. Words are counted before the join, so it sees one row for each group and word, however hot."""
    words = rows.select(*by, F.explode(F.array_distinct(X.tokens(F.col(text)))).alias(keyword)).groupBy(*by, keyword).agg(F.count(F.lit(1)).alias("n"))
    return words.join(keywords.select(keyword).distinct(), keyword)


def gated(rates: DataFrame, differences: DataFrame, candidate: str, base: str, of: Column) -> DataFrame:
    """Format rates and joint differences of every candidate but the base, with the gate's verdict.

    ``differences`` has ``attributes``, point, low and high (``paired_bootstrap``); ``of`` names the
    row that is a candidate's. The low end of the interval is what the gate asks for.
    """
    b = rates.where(F.col(candidate) == base).select(F.col("structure").alias("_s"), F.col("invalid").alias("_i"))
    j = rates.where(F.col(candidate) != base).join(F.broadcast(b))  # one row
    j = j.join(differences, of == F.col("attributes"))
    verdict = gate(F.col("structure"), F.col("_s"), F.col("leakage"), F.col("invalid"), F.col("_i"), F.col("point"), F.col("low"))
    return j.select(candidate, "structure", "leakage", "invalid", F.col("point").alias("delta"), "low", "high", verdict.alias("verdict"))


def greedy_extras(truth: Column, gen: Column, threshold: float = 0.5, similarity: Callable[[Column, Column], Column] = X.token_dice) -> Column:
    """Greedy matching of two lists: struct of soft (summed similarity), hits, n_fab, fn.

    Pairs at or above the threshold leave in order of similarity, then position of the generated
    and of the truth element; an unmatched generated element is a fabrication, an uncovered truth
    element a miss. Lists are short (one sample's extras), so the table stays in one row.
    """
    pairs = F.flatten(F.transform(gen, lambda g, i: F.transform(truth, lambda t, j: F.struct((-similarity(t, g)).alias("s"), i.alias("i"), j.alias("j")))))
    order = F.array_sort(F.filter(pairs, lambda p: p["s"] <= -threshold))
    empty = F.array().cast("array<int>")
    state = F.struct(empty.alias("i"), empty.alias("j"), F.lit(0.0).alias("soft"))
    done = F.aggregate(
        order,
        state,
        lambda acc, p: F.when(F.array_contains(acc["i"], p["i"]) | F.array_contains(acc["j"], p["j"]), acc).otherwise(
            F.struct(F.concat(acc["i"], F.array(p["i"])).alias("i"), F.concat(acc["j"], F.array(p["j"])).alias("j"), (acc["soft"] - p["s"]).alias("soft"))
        ),
    )
    return F.struct(F.round(done["soft"], 6).alias("soft"), F.size(done["i"]).alias("hits"), (F.size(gen) - F.size(done["i"])).alias("n_fab"), (F.size(truth) - F.size(done["j"])).alias("fn"))
