"""Captions and candidates before the gate (FIL-12, FIL-16, AGG-19, AGG-25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import metrics as M
from weftline.plans.base import query
from weftline.plans.scalars import DICE_SQL, PHRASES, STR10_SQL
from weftline.plans.scoring import CANDIDATE_SQL, attribute_pairs, judged

# Captions: the sentences of STR-10 around a part's name, some longer, some of two sentences, some broken.
_PHRASE = "replace(CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END, '{}', split_part(p_name, ' ', 1))"
CAPTION_SQL = f"""c AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 31 = 0 THEN {_PHRASE} || ' | ' || p_type WHEN p_partkey % 37 = 0 THEN '{{"text": ' || {_PHRASE} WHEN p_partkey % 41 = 0 THEN ' '
WHEN p_partkey % 7 = 0 THEN {_PHRASE} || '. It is here.' ELSE {_PHRASE} || repeat(' more', p_size % 25) END AS x FROM part)"""
_INVALID = r"(trim(x) = '' OR regexp_matches(x, '^\s*[\{\[]') OR contains(x, '|'))"
_SINGLE = "len(regexp_extract_all(x, '[.!?]')) <= 1"
_SUBJECT = rf"regexp_matches(lower(substr(x, 1, 40)), '{X.SUBJECT}')"
_LEAK = rf"regexp_matches(lower(x), '\b(?:{'|'.join(X.BACKGROUND)})\b')"
_WORDS = "len(regexp_extract_all(lower(x), '[a-z0-9]+'))"
RATE_SQL = f"""round(avg(({_SINGLE})::INT), 6) AS single, round(avg({_SUBJECT}::INT), 6) AS subject_first, round(avg(({_SINGLE} AND {_SUBJECT} AND NOT {_INVALID})::INT), 6) AS structure,
round(avg({_LEAK}::INT), 6) AS leakage, round(avg({_INVALID}::INT), 6) AS invalid, round(avg(({_WORDS} BETWEEN 18 AND 24)::INT), 6) AS in_range, round(avg({_WORDS}), 6) AS mean_words"""


def captions(t):
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    x = F.replace(phrase, F.lit("{}"), F.split_part("p_name", F.lit(" "), F.lit(1)))
    k = F.col("p_partkey")
    broken = F.when(k % 31 == 0, F.concat(x, F.lit(" | "), "p_type")).when(k % 37 == 0, F.concat(F.lit('{"text": '), x)).when(k % 41 == 0, F.lit(" "))
    return t.part.select("p_partkey", "p_type", broken.when(k % 7 == 0, F.concat(x, F.lit(". It is here."))).otherwise(F.concat(x, F.repeat(F.lit(" more"), F.col("p_size") % 25))).alias("x"))


@query("agg_25_format_rates", f"WITH {CAPTION_SQL} SELECT p_type, count(*) AS n, {RATE_SQL} FROM c GROUP BY 1")
def _(t):
    """Single sentence, subject first, the structure gate, background leakage, invalid output, 18 to 24 words."""
    return M.format_rates(captions(t), "x", ["p_type"])


@query("agg_19_mention_rate", f"WITH a AS ({STR10_SQL}) SELECT p_type, " + ", ".join(f"round(avg({k}::INT), 6) AS {k}" for k in (*X.LEXICON, "held", "carried")) + " FROM a JOIN part USING (p_partkey) GROUP BY 1")
def _(t):
    """How many captions mention each attribute category, with the parser's traps."""
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    text = F.replace(phrase, F.lit("{}"), F.split_part("p_name", F.lit(" "), F.lit(1)))
    return t.part.groupBy("p_type").agg(*[F.round(F.avg(c.cast("int")), 6).alias(k) for k, c in X.attributes(text).items()])


@query("fil_12_background_words", f"""WITH {CAPTION_SQL}, k(keyword) AS (VALUES {', '.join(f"('{w}')" for w in X.BACKGROUND)}),
h AS (SELECT p_partkey, p_type, keyword FROM (SELECT DISTINCT p_partkey, p_type, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS keyword FROM c) JOIN k USING (keyword))
SELECT p_type, keyword, count(*) AS n FROM h GROUP BY 1, 2""")
def _(t):
    """Texts that mention a word of a dimension table, joined on words: the table may be of any size."""
    words = t.spark.createDataFrame([(w,) for w in X.BACKGROUND], "keyword string")
    return M.keyword_counts(captions(t), ["p_type"], "x", words, "keyword").select("p_type", "keyword", "n")


# Candidates for the gate: all but ``same`` have the better attributes of AGG-21; each of the others breaks one rule.
_BASE = "'A person with a ' || p_name || ' by ' || p_brand || '.'"
GATE_CAPTIONS_SQL = f"""cap AS (SELECT candidate, CASE WHEN candidate = 'leaky' AND p_partkey % 20 = 0 THEN {_BASE} || ' near a wall' WHEN candidate = 'broken' AND p_partkey % 125 = 0 THEN {_BASE} || ' |'
WHEN candidate = 'loose' AND p_partkey % 10 = 0 THEN {_BASE} || ' It is.' ELSE {_BASE} END AS x FROM part, (VALUES ('base'), ('better'), ('leaky'), ('broken'), ('loose'), ('same')) k(candidate)),
fr AS (SELECT candidate, {RATE_SQL} FROM cap GROUP BY 1)"""
_both = lambda s, g: f"sum(CASE WHEN t IS NOT NULL AND {g} IS NOT NULL THEN {s} ELSE 0 END) AS tp, sum(CASE WHEN t IS NOT NULL AND {g} IS NOT NULL THEN 2 * (1 - {s}) WHEN t IS NOT NULL THEN 1 ELSE 0 END) AS off"
_judge = lambda g: f"(floor((1 - levenshtein(t, {g}) / greatest(length(t), length({g}))) * 4 + 0.5) / 4)"
_named = lambda s, g, n: _both(s, g).replace(" AS tp", f" AS tp_{n}").replace(" AS off", f" AS off_{n}")
JOINT_SQL = f"""js AS (SELECT session, sum(tp) AS tp_la, sum(fp + fn) AS off_la, {_named('s2', 'g2', 'lb')}, {_named(_judge('g'), 'g', 'ja')}, {_named(_judge('g2'), 'g2', 'jb')} FROM c2 GROUP BY 1),
rk AS (SELECT *, row_number() OVER (ORDER BY session) - 1 AS rank, count(*) OVER () AS n FROM js),
d AS (SELECT rep, (('0x' || substr(md5('boot|' || rep || '|' || draw), 1, 8))::BIGINT * n) >> 32 AS rank FROM (SELECT DISTINCT n FROM rk), range(2000) r(rep), range((SELECT count(*) FROM js)) i(draw))"""
_F1 = "2 * sum(tp_{0}) / (2 * sum(tp_{0}) + sum(off_{0}))"
JOINT_DIFF_SQL = f"(({_F1.format('lb')}) + ({_F1.format('jb')}) - ({_F1.format('la')}) - ({_F1.format('ja')})) / 2"


def joint_sums(t):
    """By session tp, fp and fn of base (a) and candidate (b) under the lexical scorer (l) and the judge (j)."""
    pairs = attribute_pairs(t).join(t.part.select(F.col("p_partkey").alias("id"), "p_size"), "id", "left")
    other = F.when(F.col("truth").isNull(), F.col("gen")).when(F.col("p_size") % 2 == 0, F.col("truth")[0]).otherwise(F.col("gen"))
    out = None
    for x, rows in (("a", pairs), ("b", pairs.withColumn("gen", other))):
        for s, scorer in (("l", X.token_dice), ("j", judged)):
            part = M.attribute_outcomes(rows, scorer).groupBy("session").agg(*[F.sum(c).alias(f"{c}_{s}{x}") for c in ("tp", "fp", "fn")])
            out = part if out is None else out.join(part, "session")
    return out


def joint_difference(c):
    f = lambda k: M.soft_f1(c[f"tp_{k}"], c[f"fp_{k}"], c[f"fn_{k}"])
    return (f("lb") + f("jb") - f("la") - f("ja")) / 2


@query("fil_16_gate_verdict", f"""WITH {CANDIDATE_SQL}, {GATE_CAPTIONS_SQL}, {JOINT_SQL}, v AS (SELECT rep, {JOINT_DIFF_SQL} AS diff FROM d JOIN rk USING (rank) GROUP BY 1), pt AS (SELECT {JOINT_DIFF_SQL} AS diff FROM js),
b AS (SELECT round(any_value(pt.diff), 6) AS delta, round(quantile_cont(v.diff, 0.025), 6) AS low, round(quantile_cont(v.diff, 0.975), 6) AS high FROM v, pt),
r AS (SELECT fr.candidate, fr.structure, fr.leakage, fr.invalid, base.structure AS b_structure, base.invalid AS b_invalid, CASE WHEN fr.candidate = 'same' THEN 0 ELSE delta END AS delta, CASE WHEN fr.candidate = 'same' THEN 0 ELSE low END AS low, CASE WHEN fr.candidate = 'same' THEN 0 ELSE high END AS high FROM fr, fr base, b WHERE base.candidate = 'base' AND fr.candidate <> 'base')
SELECT candidate, structure, leakage, invalid, delta, low, high, CASE WHEN structure < 0.95 OR structure - b_structure < -0.01 THEN 'structure' WHEN leakage > 0.01 THEN 'leakage' WHEN invalid - b_invalid > 0.005 THEN 'invalid' WHEN delta <= 0.005 OR low <= 0 THEN 'joint_f1' ELSE 'pass' END AS verdict FROM r""")
def _(t):
    """Five candidates against the base: format rates of their captions, joint F1 difference and its interval."""
    base = F.concat(F.lit("A person with a "), "p_name", F.lit(" by "), "p_brand", F.lit("."))
    k, c = F.col("p_partkey"), F.col("candidate")
    rows = t.part.select("p_partkey", base.alias("base"), F.explode(F.array(*[F.lit(n) for n in ("base", "better", "leaky", "broken", "loose", "same")])).alias("candidate"))
    tail = F.when((c == "leaky") & (k % 20 == 0), " near a wall").when((c == "broken") & (k % 125 == 0), " |").when((c == "loose") & (k % 10 == 0), " It is.").otherwise("")
    rates = M.format_rates(rows.select("candidate", F.concat("base", tail).alias("x")), "x", ["candidate"])
    sums = [f"{m}_{k}" for k in ("la", "lb", "ja", "jb") for m in ("tp", "fp", "fn")]
    diff = M.paired_bootstrap(joint_sums(t), "session", sums, {"better": joint_difference, "same": lambda s: joint_difference(s | {f"{m}_{k}b": s[f"{m}_{k}a"] for k in "lj" for m in ("tp", "fp", "fn")})})
    return M.gated(rates, diff.withColumnRenamed("statistic", "attributes"), "candidate", "base", F.when(c == "same", "same").otherwise("better"))
