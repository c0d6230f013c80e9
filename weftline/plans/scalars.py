"""Row-wise functions (PRJ, STR, JSN, ARR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import geometry as G
from weftline.functions import reward as R
from weftline.functions import text as X
from weftline.operators import metrics as M
from weftline.plans.base import query

#: A line item as a region: a box of pixels in an image of 1280 by 720.
BOX_SQL = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 20 AS x1, l_discount * 5000 AS y1, l_quantity * 20 + l_extendedprice / 200 AS x2, l_discount * 5000 + l_tax * 4000 + 10 AS y2 FROM lineitem"


def boxes(t):
    x1, y1 = F.col("l_quantity") * 20, F.col("l_discount") * 5000
    box = F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + F.col("l_extendedprice") / 200).alias("x2"), (y1 + F.col("l_tax") * 4000 + 10).alias("y2"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", box.alias("b"))


@query("prj_1_box_quantise", f"SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(floor(x1 / 1.28), 0), 999)::BIGINT AS q1, least(greatest(floor(y1 / 0.72), 0), 999)::BIGINT AS q2, least(greatest(floor(x2 / 1.28::DOUBLE), 0), 999)::BIGINT AS q3, least(greatest(floor(y2 / 0.72::DOUBLE), 0), 999)::BIGINT AS q4 FROM ({BOX_SQL})".replace("1.28,", "1.28::DOUBLE,").replace("0.72,", "0.72::DOUBLE,"))
def _(t):
    b = boxes(t)
    q = lambda c, side, n: G.quantise(F.col(f"b.{c}"), side).alias(n)
    return b.select("l_orderkey", "l_linenumber", "l_partkey", q("x1", 1280, "q1"), q("y1", 720, "q2"), q("x2", 1280, "q3"), q("y2", 720, "q4"))


@query("prj_2_prompt", "SELECT p_partkey, 'Describe the ' || lower(p_type) || ' ' || p_name || ' in <loc_' || p_size || '>' AS prompt FROM part")
def _(t):
    return t.part.select("p_partkey", F.format_string("Describe the %s %s in <loc_%d>", F.lower("p_type"), "p_name", "p_size").alias("prompt"))


@query("prj_3_sizes", f"SELECT l_orderkey, l_linenumber, l_partkey, round((x2 - x1) * (y2 - y1), 6) AS area, round(least(x2 - x1, y2 - y1), 6) AS edge, round((x2 - x1) / (y2 - y1), 6) AS aspect FROM ({BOX_SQL})")
def _(t):
    w, h = F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")
    return boxes(t).select("l_orderkey", "l_linenumber", "l_partkey", F.round(G.area(F.col("b")), 6).alias("area"), F.round(G.short_edge(w, h), 6).alias("edge"), F.round(G.aspect_ratio(w, h), 6).alias("aspect"))


@query("prj_4_centres", f"SELECT l_orderkey, l_linenumber, l_partkey, round((x1 + x2) / 2, 6) AS cx, round((y1 + y2) / 2, 6) AS cy FROM ({BOX_SQL})")
def _(t):
    x, y = G.centre(F.col("b"))
    return boxes(t).select("l_orderkey", "l_linenumber", "l_partkey", F.round(x, 6).alias("cx"), F.round(y, 6).alias("cy"))


@query("prj_5_iou", f"""WITH b AS (SELECT l_orderkey, l_linenumber, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2 FROM ({BOX_SQL}) GROUP BY 1, 2)
SELECT a.l_orderkey, a.l_linenumber AS i, c.l_linenumber AS j,
round(greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0)), 6) AS iou
FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.l_linenumber < c.l_linenumber""")
def _(t):
    b = boxes(t).groupBy("l_orderkey", "l_linenumber").agg(*[F.min(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    one = b.select("l_orderkey", F.col("l_linenumber").alias("i"), F.struct("x1", "y1", "x2", "y2").alias("p"))
    two = b.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j"), F.struct("x1", "y1", "x2", "y2").alias("q"))
    return one.join(two, (F.col("l_orderkey") == F.col("k")) & (F.col("i") < F.col("j"))).select("l_orderkey", "i", "j", F.round(G.iou(F.col("p"), F.col("q")), 6).alias("iou"))


@query("prj_6_id_parsing", r"SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '://([^/]+)', 1) AS scene, regexp_extract(url, '/([a-z]{2})/', 1) AS session, try_cast(regexp_extract(url, '/(\d+)', 1) AS INT) AS frame FROM pages")
def _(t):
    e = lambda p, n: F.regexp_extract("url", p, 1).alias(n)
    return t.pages.select("page_id", e(r"^(https?)://", "scheme"), e(r"://([^/]+)", "scene"), e(r"/([a-z]{2})/", "session"), F.regexp_extract("url", r"/(\d+)", 1).try_cast("int").alias("frame"))


@query("prj_7_scale_class", f"SELECT s, count(*) AS n FROM (SELECT CASE WHEN a < 0.01 THEN 'tiny' WHEN a < 0.05 THEN 'small' WHEN a < 0.2 THEN 'medium' ELSE 'large' END AS s FROM (SELECT (x2 - x1) * (y2 - y1) / 921600 AS a FROM ({BOX_SQL}))) GROUP BY 1")
def _(t):
    return boxes(t).groupBy(G.scale_class(G.area(F.col("b")) / 921600).alias("s")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_8_token_count", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", X.token_count(F.col("text")).alias("n"))


@query("prj_9_pixel_ratio", "SELECT l_orderkey, l_linestatus, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey), 6) AS ratio FROM lineitem GROUP BY 1, 2")
def _(t):
    from pyspark.sql import Window

    g = t.lineitem.groupBy("l_orderkey", "l_linestatus").agg(F.sum("l_quantity").alias("px"))
    return g.select("l_orderkey", "l_linestatus", F.round(F.col("px") / F.sum("px").over(Window.partitionBy("l_orderkey")), 6).alias("ratio"))


@query("prj_10_reward", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE round(greatest(least(0.4 * (l_quantity / 50) - 0.4 * l_discount * 10 + 0.1 - 0.05 * (l_linenumber % 2) - 0.1 * l_tax * 10, 1.0), -1.0), 6) END AS reward FROM lineitem""")
def _(t):
    c = F.col
    r = R.reward(c("l_quantity") / 50, c("l_discount") * 10, F.lit(1.0), -0.5 * (c("l_linenumber") % 2), c("l_tax") * 10, c("l_returnflag") == "R")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(r, 6).alias("reward"))


@query("prj_11_alpha_schedule", "SELECT event_id, round(0.1 + least(event_id / 748.0, 1.0) * 0.4, 6)::DOUBLE AS alpha, round((1 - (0.1 + least(event_id / 748.0, 1.0) * 0.4)) * value + (0.1 + least(event_id / 748.0, 1.0) * 0.4) * (value - 1), 6)::DOUBLE AS loss FROM events".replace("748.0", "748.0::DOUBLE").replace("0.4", "0.4::DOUBLE"))
def _(t):
    a = R.alpha(F.col("event_id"))
    return t.events.select("event_id", F.round(a, 6).alias("alpha"), F.round(R.mixed_loss(a, F.col("value"), R.scst_advantage(F.col("value"), F.lit(1.0))), 6).alias("loss"))


@query("str_1_tokens", "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') AS tokens FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


TURNS_SQL = "SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def turns(t):
    """Each turn beside the next: generated and reference text of one sample."""
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("x"))
    b = t.conversations.select(F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("text").alias("y"))
    return a.join(b, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t"))).select("conv_id", "turn", "x", "y")


@query("str_2_word_f1", f"""WITH p AS ({TURNS_SQL}), a AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(x), '[a-z0-9]+')) AS w FROM p) GROUP BY 1, 2, 3),
b AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(y), '[a-z0-9]+')) AS w FROM p) GROUP BY 1, 2, 3),
s AS (SELECT conv_id, turn, sum(least(a.n, b.n)) AS s FROM a JOIN b USING (conv_id, turn, w) GROUP BY 1, 2),
n AS (SELECT conv_id, turn, coalesce(s, 0) AS s, len(regexp_extract_all(lower(x), '[a-z0-9]+')) AS g, len(regexp_extract_all(lower(y), '[a-z0-9]+')) AS t FROM p LEFT JOIN s USING (conv_id, turn))
SELECT conv_id, turn, round(CASE WHEN g > 0 THEN s / g ELSE 0 END, 6) AS p, round(CASE WHEN t > 0 THEN s / t ELSE 0 END, 6) AS r, round(CASE WHEN s > 0 THEN 2 * (s / g) * (s / t) / (s / g + s / t) ELSE 0 END, 6) AS f1 FROM n""")
def _(t):
    rows = turns(t).select("conv_id", "turn", X.tokens(F.col("x")).alias("a"), X.tokens(F.col("y")).alias("b"))
    got = M.token_overlap(rows, ["conv_id", "turn"], "a", "b")
    p, r, f = X.precision_recall_f1(F.col("shared").cast("double"), F.col("n_a"), F.col("n_b"))
    return got.select("conv_id", "turn", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f, 6).alias("f1"))


# Longest common subsequence: places of equal words, by the first text and backwards by the second, of which the longest rising
# sequence is taken by the smallest ends of sequences of every length.
ROUGE_SQL = f"""p AS (SELECT q.*, role FROM ({TURNS_SQL}) q JOIN conversations USING (conv_id, turn)), w AS (SELECT *, regexp_extract_all(lower(x), '[a-z0-9]+') AS a, regexp_extract_all(lower(y), '[a-z0-9]+') AS b FROM p),
e AS (SELECT conv_id, turn, unnest(a) AS w, unnest(range(1, len(a) + 1)) AS i FROM w), f AS (SELECT conv_id, turn, unnest(b) AS w, unnest(range(1, len(b) + 1)) AS j FROM w),
h AS (SELECT conv_id, turn, list([j] ORDER BY i, j DESC) AS hits FROM e JOIN f USING (conv_id, turn, w) GROUP BY 1, 2),
l AS (SELECT w.conv_id, w.turn, role, len(a) AS na, len(b) AS nb, length(x) AS cx, x, y, CASE WHEN hits IS NULL THEN 0 ELSE len(list_reduce(list_prepend([]::BIGINT[], hits), lambda tails, h: list_concat(list_filter(tails, lambda z: z < h[1]), [h[1]], tails[len(list_filter(tails, lambda z: z < h[1])) + 2:]))) END AS n FROM w LEFT JOIN h USING (conv_id, turn)),
r AS (SELECT conv_id, turn, role, x, y, CASE WHEN n > 0 THEN 2 * (n / na) * (n / nb) / (n / na + n / nb) ELSE 0 END AS l FROM l)"""


@query("str_3_rouge_l", f"WITH {ROUGE_SQL} SELECT conv_id, turn, round(l, 6)::DOUBLE AS rouge_l FROM r")
def _(t):
    rows = turns(t).select("conv_id", "turn", X.tokens(F.col("x")).alias("a"), X.tokens(F.col("y")).alias("b"))
    return rows.select("conv_id", "turn", F.round(X.rouge_l(F.col("a"), F.col("b")), 6).alias("rouge_l"))


@query("str_4_char_similarity", "SELECT p_partkey, round(1 - levenshtein(p_name, lower(p_type)) / greatest(length(p_name), length(p_type)), 6) AS sim FROM part")
def _(t):
    return t.part.select("p_partkey", F.round(X.char_similarity(F.col("p_name"), F.lower("p_type")), 6).alias("sim"))


@query("str_5_hashed_cosine", """WITH g AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark)),
c AS (SELECT item_id, (('0x' || substr(md5(g), 1, 8))::BIGINT % 256) AS b, count(*)::DOUBLE AS n FROM g GROUP BY 1, 2), nn AS (SELECT item_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1),
d AS (SELECT x.item_id AS a, y.item_id AS b, sum(x.n * y.n) AS dot FROM c x JOIN c y ON x.b = y.b AND y.item_id = x.item_id + 1 GROUP BY 1, 2)
SELECT d.a, d.b, round(dot / (p.norm * q.norm), 6) AS cosine FROM d JOIN nn p ON p.item_id = d.a JOIN nn q ON q.item_id = d.b""")
def _(t):
    long = t.benchmark.select("item_id", F.explode(X.hashed_vector(F.col("text"))).alias("bucket")).groupBy("item_id", "bucket").agg(F.count(F.lit(1)).cast("double").alias("n"))
    norm = long.groupBy("item_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    x = long.select(F.col("item_id").alias("a"), "bucket", "n")
    y = long.select((F.col("item_id") - 1).alias("_a"), F.col("bucket").alias("_b"), F.col("n").alias("m"))
    dot = x.join(y, (F.col("a") == F.col("_a")) & (F.col("bucket") == F.col("_b"))).groupBy("a").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    p, q = norm.select(F.col("item_id").alias("a"), F.col("norm").alias("p")), norm.select((F.col("item_id") - 1).alias("a"), F.col("norm").alias("q"))
    return dot.join(p, "a").join(q, "a").select("a", (F.col("a") + 1).alias("b"), F.round(F.col("dot") / (F.col("p") * F.col("q")), 6).alias("cosine"))


DICE_SQL = "CASE WHEN len(list_distinct({a})) + len(list_distinct({b})) > 0 THEN 2.0 * len(list_intersect(list_distinct({a}), list_distinct({b}))) / (len(list_distinct({a})) + len(list_distinct({b}))) ELSE 0 END"


@query("str_6_value_similarity", "SELECT a.p_partkey, round(" + DICE_SQL.format(a="regexp_extract_all(lower(a.p_name), '[a-z0-9]+')", b="regexp_extract_all(lower(b.p_name), '[a-z0-9]+')") + ", 6)::DOUBLE AS s FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(t):
    a = t.part.select("p_partkey", "p_name")
    b = t.part.select((F.col("p_partkey") - 1).alias("_k"), F.col("p_name").alias("other"))
    return a.join(b, F.col("p_partkey") == F.col("_k")).select("p_partkey", F.round(X.token_dice(F.col("p_name"), F.col("other")), 6).alias("s"))


@query("str_7_sentence_structure", "SELECT doc_id, len(regexp_extract_all(text, '[.!?]'))::BIGINT AS ends, len(regexp_extract_all(text, '[.!?]')) <= 1 AND regexp_matches(lower(substr(text, 1, 40)), '(the|der|les|los)') AS one FROM documents")
def _(t):
    return t.documents.select("doc_id", X.sentence_ends(F.col("text")).alias("ends"), X.one_sentence(F.col("text"), "(the|der|les|los)").alias("one"))


@query("str_8_length_score", "SELECT s, count(*) AS n FROM (SELECT CASE WHEN w BETWEEN 18 AND 24 THEN 1.0::DOUBLE WHEN w BETWEEN 12 AND 17 OR w BETWEEN 25 AND 28 THEN -0.5 ELSE -1.0 END AS s FROM (SELECT len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations)) GROUP BY 1")
def _(t):
    return t.conversations.groupBy(X.length_score(X.token_count(F.col("text"))).alias("s")).agg(F.count(F.lit(1)).alias("n"))


@query("str_9_parse_regions", """WITH r AS (SELECT p_partkey, p_name || ' <loc_' || p_size || '><loc_' || (p_partkey % 1200) || '><loc_3><loc_4><sep>' || p_type || ' <loc_1><loc_2>' AS raw FROM part),
s AS (SELECT p_partkey, unnest([1, 2]) AS pos, str_split(raw, '<sep>') AS parts FROM r), q AS (SELECT p_partkey, pos, parts[pos] AS raw, regexp_extract_all(parts[pos], '<loc_(\\d+)>', 1) AS loc FROM s)
SELECT p_partkey, (pos - 1)::INT AS pos, trim(regexp_replace(raw, '<loc_\\d+>', '', 'g')) AS description, CASE WHEN len(loc) = 4 AND len(list_filter(loc, lambda x: x::INT > 999)) = 0 THEN array_to_string(loc, ',') END AS loc, raw FROM q""".replace("\\\\", "\\"))
def _(t):
    raw = F.concat("p_name", F.lit(" <loc_"), "p_size", F.lit("><loc_"), F.col("p_partkey") % 1200, F.lit("><loc_3><loc_4><sep>"), "p_type", F.lit(" <loc_1><loc_2>"))
    parts = t.part.select("p_partkey", F.posexplode(X.parse_regions(raw)).alias("pos", "r"))
    return parts.select("p_partkey", "pos", "r.description", F.array_join(F.transform("r.loc", lambda x: x.cast("string")), ",").alias("loc"), "r.raw")


#: Sentences with the traps, around the first word of a part's name.
PHRASES = (
    "A woman in a {} dress, standing", "A man holding a {} jacket and wearing boots", "Someone wearing a {} backpack by a {} wall", "A person carrying the {} umbrella, {} background",
    "Long curly black hair, bald spot, {} shirt", "A {} handbag", "A girl with a {} bag, sunglasses and a grey skirt, walking", "nothing {} here",
)
_WORDS = {k: v for k, v in X.LEXICON.items()}
_HELD = r"\b(?:holding|carrying)\s+" + X.THING + "(?:" + X.CARRIED + r")\b"
STR10_SQL = (
    "WITH s AS (SELECT p_partkey, lower(replace(CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END, '{}', split_part(p_name, ' ', 1))) AS t FROM part), "
    r"p AS (SELECT p_partkey, regexp_replace(t, '\b[a-z]+\s+(?:background|wall)\b', ' ', 'g') AS plain FROM s), "
    "w AS (SELECT p_partkey, plain, regexp_replace(plain, '" + _HELD + "', ' ', 'g') AS worn FROM p) SELECT p_partkey, "
    + ", ".join(f"regexp_matches({'plain' if k in ('colour', 'pose') else 'worn'}, '\\b(?:{v})\\b') AS {k}" for k, v in _WORDS.items())
    + f", regexp_matches(plain, '{_HELD}') AS held, regexp_matches(worn, '" + r"\b(?:wearing|with)\s+" + X.THING + r"(?:bag|handbag|backpack)\b" + "') AS carried FROM w"
)


@query("str_10_attribute_words", STR10_SQL)
def _(t):
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    text = F.replace(phrase, F.lit("{}"), F.split_part("p_name", F.lit(" "), F.lit(1)))
    rows = t.part.select("p_partkey", text.alias("text"))
    return rows.select("p_partkey", *[c.alias(k) for k, c in X.attributes(F.col("text")).items()])


@query("str_11_snap_score", "SELECT event_id, coalesce(least(greatest(floor(try_cast(raw AS DOUBLE) * 4 + 0.5) / 4, 0.0), 1.0), 0.0)::DOUBLE AS s FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE (value / 100)::VARCHAR END AS raw FROM events)")
def _(t):
    raw = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise((F.col("value") / 100).cast("string"))
    return t.events.select("event_id", X.snap_score(raw).alias("s"))


@query("str_12_closed_vocabulary", r"""SELECT p_partkey, CASE WHEN c = '' THEN 'unknown' ELSE coalesce(c, 'unknown') END AS colour
FROM (SELECT p_partkey, regexp_extract(regexp_replace(lower(CASE WHEN p_partkey % 5 = 0 THEN 'Light Grey ' ELSE p_type || ' ' END || p_name), '\bgrey\b', 'gray', 'g'), '\b(black|white|gray|red|yellow|green|blue|purple|pink|orange|brown)\b', 1) AS c FROM part)""".replace("\\\\", "\\"))
def _(t):
    text = F.concat(F.when(F.col("p_partkey") % 5 == 0, "Light Grey ").otherwise(F.concat("p_type", F.lit(" "))), "p_name")
    return t.part.select("p_partkey", X.closed_colour(text).alias("colour"))


@query("str_13_cache_key", "SELECT p_partkey, sha256(p_type || chr(1) || p_name || chr(1) || p_brand) AS k FROM part")
def _(t):
    return t.part.select("p_partkey", X.cache_key(F.col("p_type"), F.col("p_name"), F.col("p_brand")).alias("k"))


@query("jsn_1_parse_with_fallback", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), -1)::INT AS k, json_valid(props) AS ok FROM events")
def _(t):
    p = F.from_json("props", "k int, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return t.events.select("event_id", F.coalesce(p["k"], F.lit(-1)).alias("k"), p["_corrupt"].isNull().alias("ok"))


@query("jsn_2_unpivot", "SELECT p_partkey, 'brand' AS field, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'name', p_name FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part")
def _(t):
    """Fields that are columns already; ``jsn_2_flatten`` takes nested ones."""
    return t.part.select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_type").alias("type")).unpivot(["p_partkey"], ["brand", "name", "type"], "field", "value")


@query("arr_1_best_element", "SELECT p_partkey, round(greatest(" + DICE_SQL.format(a="regexp_extract_all(lower(p_name), '[a-z0-9]+')", b="['red', 'ring']") + ", " + DICE_SQL.format(a="regexp_extract_all(lower(p_type), '[a-z0-9]+')", b="['red', 'ring']") + "), 6)::DOUBLE AS s FROM part")
def _(t):
    return t.part.select("p_partkey", F.round(X.best_element(X.normalise_values(F.array("p_name", "p_type")), F.lit("red ring")), 6).alias("s"))


@query("arr_3_multi_hot", "SELECT c_custkey, array_to_string([(c_mktsegment = x)::INT FOR x IN ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']], '') AS hot FROM customer")
def _(t):
    hot = X.multi_hot(F.array("c_mktsegment"), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    return t.customer.select("c_custkey", F.array_join(F.transform(hot, lambda x: x.cast("string")), "").alias("hot"))


CODE_SQL = "SELECT vec_id, label, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 64), lambda i: (embedding[i + 1] > embedding[i])::BIGINT)), lambda a, x: a * 2 + x) AS code FROM embeddings"


@query("arr_4_sign_code_hamming", f"WITH c AS ({CODE_SQL}) SELECT a.vec_id, a.code, bit_count(xor(a.code, b.code))::INT AS d FROM c a JOIN c b ON b.vec_id = a.vec_id + 1")
def _(t):
    c = t.embeddings.select("vec_id", X.sign_code(F.col("embedding")).alias("code"))
    n = c.select((F.col("vec_id") - 1).alias("_k"), F.col("code").alias("other"))
    return c.join(n, F.col("vec_id") == F.col("_k")).select("vec_id", "code", X.hamming(F.col("code"), F.col("other")).alias("d"))
