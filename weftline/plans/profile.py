"""Profiles, filters and set operations (AGG-1..6, 16, 17, 23; FIL; SET; SNK-3; RUN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import geometry as G
from weftline.functions import text as X
from weftline.operators import metrics
from weftline.plans.base import query
from weftline.sources import io


@query("agg_1_share_by_group", "SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def _(t):
    from pyspark.sql import Window

    g = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("agg_2_pivot_with_total", """SELECT coalesce(source, 'none') AS source, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr,
count(*) FILTER (lang IS NULL OR lang NOT IN ('de', 'en', 'es', 'fr')) AS other, count(*) AS n FROM documents GROUP BY 1
UNION ALL SELECT 'total', count(*) FILTER (lang = 'de'), count(*) FILTER (lang = 'en'), count(*) FILTER (lang = 'es'), count(*) FILTER (lang = 'fr'), count(*) FILTER (lang IS NULL OR lang NOT IN ('de', 'en', 'es', 'fr')), count(*) FROM documents""")
def _(t):
    # one rollup instead of a pivot and a second pass for the total; what no column names counts as other
    known = ("de", "en", "es", "fr")
    other = F.count_if(F.col("lang").isNull() | ~F.col("lang").isin(*known)).alias("other")
    g = t.documents.rollup("source").agg(*[F.count_if(F.col("lang") == x).alias(x) for x in known], other, F.count(F.lit(1)).alias("n"), F.grouping("source").alias("all"))
    return g.withColumn("source", F.when(F.col("all") == 1, "total").otherwise(F.coalesce("source", F.lit("none")))).drop("all")


@query("agg_3_multi_label_share", "SELECT c_mktsegment, round(avg((n > 10)::INT), 6) AS multi FROM (SELECT c_mktsegment, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1")
def _(t):
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    j = t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_mktsegment").agg(F.round(F.avg((F.coalesce("n", F.lit(0)) > 10).cast("int")), 6).alias("multi"))


@query("agg_4_distinct_counts", "SELECT count(DISTINCT text) AS texts, count(DISTINCT n_chars) AS sizes, count(DISTINCT source) AS sources FROM documents")
def _(t):
    # texts as digests, so that the Expand of several distinct counts carries 32 bytes, not the text
    d = t.documents.select(F.md5("text").alias("h"), "n_chars", "source")
    return d.agg(F.countDistinct("h").alias("texts"), F.countDistinct("n_chars").alias("sizes"), F.countDistinct("source").alias("sources"))


@query("agg_5_quantiles", """SELECT l_returnflag, round(median(l_extendedprice), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(avg(l_extendedprice), 6) AS mean, round(avg((l_quantity < 10)::INT), 6) AS under
FROM lineitem GROUP BY 1""")
def _(t):
    q = metrics.quantiles(t.lineitem, "l_returnflag", "l_extendedprice", {"p50": 0.5, "p95": 0.95})
    m = t.lineitem.groupBy(F.col("l_returnflag").alias("f")).agg(F.round(F.avg("l_extendedprice"), 6).alias("mean"), F.round(F.avg((F.col("l_quantity") < 10).cast("int")), 6).alias("under"))
    return q.join(m, F.col("l_returnflag").eqNullSafe(F.col("f"))).select("l_returnflag", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "mean", "under")


@query("agg_6_duplicate_profile", """SELECT kind, count(*) AS frames FROM (SELECT l_orderkey, CASE WHEN count(DISTINCT l_suppkey) = count(*) THEN 'all_unique' WHEN count(DISTINCT l_suppkey) = 1 THEN 'all_same' ELSE 'part' END AS kind
FROM lineitem GROUP BY 1) GROUP BY 1""")
def _(t):
    g = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("d"))
    kind = F.when(F.col("d") == F.col("n"), "all_unique").when(F.col("d") == 1, "all_same").otherwise("part")
    return g.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("frames"))


@query("agg_16_metric_by_bucket", "SELECT floor(l_quantity / 10)::BIGINT AS bucket, count(*) AS n, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(F.floor(F.col("l_quantity") / 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query("agg_17_threshold_scan", """WITH g(edge, area) AS (SELECT * FROM (VALUES (5), (10), (20)) a(e), (VALUES (20000), (40000), (60000)) b(x))
SELECT edge::BIGINT AS edge, area::BIGINT AS area, round(avg((l_quantity >= edge AND l_extendedprice >= area)::INT), 6) AS kept, round(avg(l_discount) FILTER (l_quantity >= edge AND l_extendedprice >= area), 6) AS metric FROM lineitem, g GROUP BY 1, 2""")
def _(t):
    # one pass: the grid is a fixed array of nine points per row, aggregated map-side
    grid = F.array(*[F.struct(F.lit(e).cast("long").alias("edge"), F.lit(a).cast("long").alias("area")) for e in (5, 10, 20) for a in (20000, 40000, 60000)])
    rows = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", F.explode(grid).alias("g")).select("*", "g.*")
    ok = (F.col("l_quantity") >= F.col("edge")) & (F.col("l_extendedprice") >= F.col("area"))
    return rows.groupBy("edge", "area").agg(F.round(F.avg(ok.cast("int")), 6).alias("kept"), F.round(F.avg(F.when(ok, F.col("l_discount"))), 6).alias("metric"))


@query("agg_23_speed", """SELECT n, count(*) AS frames, round(sum(a), 6) AS base, round(sum(b), 6) AS ours, round(sum(a) / sum(b), 6) AS speedup, round(sum(n) / sum(b), 6) AS throughput
FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS a, sum(l_quantity * (1 - l_discount)) AS b FROM lineitem GROUP BY 1) GROUP BY n""")
def _(t):
    per = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("a"), F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))).alias("b"))
    return per.groupBy("n").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("a"), 6).alias("base"), F.round(F.sum("b"), 6).alias("ours"),
                                F.round(F.sum("a") / F.sum("b"), 6).alias("speedup"), F.round(F.sum("n") / F.sum("b"), 6).alias("throughput"))


@query("fil_1_status_ok", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice > 0")
def _(t):
    return t.orders.where(F.col("o_orderstatus").isin("O", "F") & (F.col("o_totalprice") > 0)).select("o_orderkey", "o_custkey")


@query("fil_2_frames_with_regions", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 25)")
def _(t):
    return t.orders.join(t.lineitem.where("l_quantity >= 25").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("fil_3_consistency", "SELECT conv_id, count(*) AS boxes, count(text) AS descriptions FROM conversations GROUP BY 1 HAVING count(*) <> count(text) OR count(*) <> max(turn) + 1")
def _(t):
    g = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("boxes"), F.count("text").alias("descriptions"), F.max("turn").alias("m"))
    return g.where("boxes <> descriptions or boxes <> m + 1").drop("m")


@query("fil_4_small_files", "SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes FROM documents WHERE octet_length(encode(text)) >= 1000")
def _(t):
    """A document as a file: small ones are skipped by their own size. ``io.large_files`` does so from a listing."""
    size = F.octet_length("text").cast("long")
    return t.documents.where(size >= 1000).select("doc_id", size.alias("bytes"))


@query("fil_5_confidence", "SELECT event_id, value FROM events WHERE value / 100 >= 0.3")
def _(t):
    return t.events.where(F.col("value") / 100 >= 0.3).select("event_id", "value")


@query("fil_6_small_input", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, least(l_quantity * 10, l_extendedprice / 100) AS edge, l_quantity * 10 * (l_extendedprice / 100) AS area FROM lineitem)
SELECT p.name AS preset, count(*) AS n, count(*) FILTER (edge < p.e) AS short_edge, count(*) FILTER (edge >= p.e AND area < p.a) AS area, round(avg((edge < p.e OR area < p.a)::INT), 6) AS dropped
FROM r, (VALUES ('loose', 80, 15000), ('balanced', 96, 25000), ('strict', 128, 40000)) p(name, e, a) GROUP BY 1""")
def _(t):
    w, h = F.col("l_quantity") * 10, F.col("l_extendedprice") / 100
    rows = t.lineitem.select(G.short_edge(w, h).alias("edge"), (w * h).alias("area"))
    reasons = F.array(*[F.struct(F.lit(n).alias("preset"), G.small_input(F.col("edge"), F.col("area"), e, a).alias("reason")) for n, e, a in G.SMALL_PRESETS])
    r = rows.select(F.explode(reasons).alias("r")).select("r.*")
    return r.groupBy("preset").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason") == "short_edge").alias("short_edge"), F.count_if(F.col("reason") == "area").alias("area"), F.round(F.avg(F.col("reason").isNotNull().cast("int")), 6).alias("dropped"))


@query("fil_9_review_routing", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'keep' WHEN '2-HIGH' THEN 'remove' WHEN '3-MEDIUM' THEN 'remove' WHEN '4-NOT SPECIFIED' THEN 'move' ELSE 'hold' END AS action
FROM orders""")
def _(t):
    p = F.col("o_orderpriority")
    # reviewed, rejected, duplicate, uncertain, unreviewed
    return t.orders.select("o_orderkey", F.when(p == "1-URGENT", "keep").when(p.isin("2-HIGH", "3-MEDIUM"), "remove").when(p == "4-NOT SPECIFIED", "move").otherwise("hold").alias("action"))


@query("fil_10_absent_values", "SELECT coalesce(v, 'absent') AS v, count(*) AS n FROM (SELECT CASE WHEN lower(trim(replace(p_type, 'SMALL', ' None '))) IN ('unknown', 'none', 'no', '') THEN NULL ELSE lower(trim(replace(p_type, 'SMALL', ' None '))) END AS v FROM part) GROUP BY 1")
def _(t):
    v = X.present(F.replace("p_type", F.lit("SMALL"), F.lit(" None ")))
    return t.part.groupBy(F.coalesce(v, F.lit("absent")).alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("fil_11_invalid_output", r"SELECT doc_id FROM documents WHERE trim(text) = '' OR regexp_matches(text, '^\s*[\{\[]') OR contains(text, '|')")
def _(t):
    return t.documents.where(X.invalid_output(F.col("text"))).select("doc_id")


@query("fil_13_rare_single_label", """WITH c AS (SELECT source FROM documents GROUP BY 1 HAVING count(*) <= (SELECT avg(n) FROM (SELECT count(*) AS n FROM documents GROUP BY source))),
m AS (SELECT md5(text) AS h FROM documents GROUP BY 1 HAVING count(DISTINCT source) = 1) SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM c) AND md5(text) IN (SELECT h FROM m)""")
def _(t):
    from pyspark.sql import Window

    d = t.documents.select("doc_id", "source", F.md5("text").alias("h"))
    counts = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    rare = counts.withColumn("mean", F.avg("n").over(Window.partitionBy())).where("n <= mean").select("source")
    single = d.groupBy("h").agg(F.countDistinct("source").alias("k")).where("k = 1").select("h")
    return d.join(rare, "source", "left_semi").join(single, "h", "left_semi").select("doc_id", "source")


@query("fil_14_label_sanity", """SELECT event_type, count(*) FILTER (k IS NULL) AS unparsed, count(*) FILTER (k >= 90) AS out_of_domain, count(*) FILTER (k < 90) AS good
FROM (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY 1""")
def _(t):
    e = t.events.select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count_if(F.col("k").isNull()).alias("unparsed"), F.count_if(F.col("k") >= 90).alias("out_of_domain"), F.count_if(F.col("k") < 90).alias("good"))


@query("fil_17_complete_rows", "SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars = length(text)")
def _(t):
    return t.documents.na.drop().where(F.col("n_chars") == F.length("text")).select("doc_id")


@query("set_1_union_with_origin", "SELECT 'document' AS origin, lower(substr(text, 1, 1)) AS initial, count(*) AS n FROM documents GROUP BY 1, 2 UNION ALL SELECT 'benchmark', lower(substr(text, 1, 1)), count(*) FROM benchmark GROUP BY 1, 2")
def _(t):
    both = t.documents.select("text", F.lit("document").alias("origin")).unionByName(t.benchmark.select("text", F.lit("benchmark").alias("origin")))
    return both.groupBy("origin", F.lower(F.substring("text", 1, 1)).alias("initial")).agg(F.count(F.lit(1)).alias("n"))


@query("set_2_partition", """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN n_chars < 100 THEN 'drop' WHEN lang <> 'en' THEN 'other' WHEN n_chars > 5000 THEN 'long' ELSE 'database' END AS kind FROM documents) GROUP BY 1""")
def _(t):
    kind = F.when(F.col("n_chars") < 100, "drop").when(F.col("lang") != "en", "other").when(F.col("n_chars") > 5000, "long").otherwise("database")
    return t.documents.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("set_3_union", "SELECT doc_id FROM documents WHERE n_chars < 500 UNION SELECT doc_id FROM documents WHERE lang = 'fr'")
def _(t):
    return t.documents.where("n_chars < 500").select("doc_id").union(t.documents.where("lang = 'fr'").select("doc_id")).distinct()


@query("set_4_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(t):
    return t.documents.select("doc_id").subtract(t.labels.select("doc_id"))


@query("set_5_intersect", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def _(t):
    return t.documents.where("lang = 'en'").select("doc_id").intersect(t.labels.where("toxic = 1").select("doc_id"))


@query("set_6_distinct_requests", "SELECT DISTINCT p_type, p_brand, p_size FROM part")
def _(t):
    return t.part.select("p_type", "p_brand", "p_size").dropDuplicates()


@query("snk_3_run_summary", "SELECT count(*) AS selected, count(*) FILTER (o_orderstatus = 'O') AS processed, count(*) FILTER (o_orderstatus = 'P') AS skipped, count(*) FILTER (o_orderstatus = 'F') AS failed FROM orders")
def _(t):
    s = F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "P", "skipped").otherwise("failed")
    return io.run_summary(t.orders.select(s.alias("status")))


@query("run_1_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return io.pending(t.documents.select("doc_id"), t.labels, "doc_id")


@query("run_2_id_check", """SELECT doc_id, CASE WHEN g IS NULL THEN 'missing' WHEN w IS NULL THEN 'unexpected' ELSE 'duplicated' END AS problem FROM (SELECT doc_id, count(*) AS w FROM documents GROUP BY 1)
FULL JOIN (SELECT doc_id, count(*) AS g FROM labels GROUP BY 1) USING (doc_id) WHERE g IS NULL OR w IS NULL OR g > w""")
def _(t):
    return io.id_check(t.documents, t.labels, "doc_id")


@query("run_3_round_robin", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS idx, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 16)::INT AS worker FROM orders")
def _(t):
    return io.round_robin(t.orders.select("o_orderkey"), "o_orderkey", 16)


@query("run_4_retry_failed", "SELECT doc_id, 'ok' AS status FROM documents WHERE n_chars >= 100 UNION ALL SELECT doc_id, 'retried' FROM documents WHERE n_chars < 100")
def _(t):
    first = t.documents.select("doc_id", F.when(F.col("n_chars") >= 100, "ok").otherwise("failed").alias("status"))
    return io.retry_failed(first, t.documents.select("doc_id", F.lit("retried").alias("status")), "doc_id")


@query("run_5_cache", "SELECT p_partkey, sha256(p_type || chr(1) || p_brand) AS cache_key, length(p_type)::INT AS value FROM part")
def _(t):
    asked = t.part.select("p_partkey", "p_type", "p_brand")
    key = X.cache_key(F.col("p_type"), F.col("p_brand"))
    old = asked.where("p_type = 'SMALL'").select(key.alias("cache_key"), F.length("p_type").alias("value")).distinct()
    answers, _ = io.cached(asked, old, key, lambda m: m.withColumn("value", F.length("p_type")))
    return answers.select("p_partkey", "cache_key", "value")


@query("run_7_limits", """WITH f AS (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY 1 LIMIT 500)
SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM f)) WHERE n <= 3""")
def _(t):
    """The limit is the feature: at most 500 frames, and the three largest regions of each."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    order = [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return io.limits(rows, "l_orderkey", order, 500, 3).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("snk_1_row_digest", """SELECT count(*) AS n, sha256(coalesce(sum(h), 0)::VARCHAR) AS digest FROM (SELECT ('0x' || substr(sha256(to_json({'p_brand': p_brand, 'p_name': p_name, 'p_partkey': p_partkey, 'p_retailprice': p_retailprice, 'p_size': p_size, 'p_type': p_type})::VARCHAR), 1, 15))::BIGINT::HUGEINT AS h FROM part)""")
def _(t):
    return io.row_digest(t.part)
