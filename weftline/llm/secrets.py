"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import carried, checkpointed

# Fixed patterns, in the order in which kinds are listed. Candidates are the method's own kind.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: A candidate value of more owners than this is a widely copied example, whatever its copies.
MAX_OWNERS = 2
#: So is one that owners share in more repositories (different texts); one owner's copies never count against it.
MAX_SHARED = 4


SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"
#: Elements of an array that are folded at once; see ``_scan``.
CHUNK = 64
LONG = 2**31 - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named, also in functions of elements."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _chunks(items: Column, size: int = CHUNK) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / size) - 1, F.lit(0)).cast("int"))
    return F.transform(starts, lambda c: F.slice(items, c * size + 1, F.lit(size)))


def _scan(items: Column, kind: str, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], zero: Column, zero_kind: str) -> Column:
    """Each item (of SQL type ``kind``) as ``m`` with ``before``: the combined values of all items before it.

    An array that grows by one element at a time costs its square, so that is done in chunks, and
    once more over the chunks: some hundred thousand items take a moment.
    """
    out = F.array().cast(f"array<struct<m:{kind},before:{zero_kind}>>")

    def inner(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, m: combine(a, value(m))))
        starts = F.aggregate(
            totals,
            F.struct(zero.alias("at"), F.array().cast(f"array<{zero_kind}>").alias("out")),
            lambda acc, t: F.struct(combine(acc["at"], t).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )
        one = lambda c, start: F.aggregate(
            c,
            F.struct(start.alias("at"), out.alias("out")),
            lambda acc, m: F.struct(combine(acc["at"], value(m)).alias("at"), F.concat(acc["out"], F.array(F.struct(m.alias("m"), acc["at"].alias("before")))).alias("out")),
            lambda acc: acc["out"],
        )
        return F.flatten(F.zip_with(chunks, starts, one))

    return _let(items, lambda arr: _let(_chunks(arr), inner))


def _spans(text: Column, pattern: str, kind: str, rank: int, value_group: int = 0) -> Column:
    """All leftmost non-overlapping matches as an array of structs start, rank, end, kind, value.

    ``split`` gives the pieces between the matches; running sums of the lengths of pieces and
    matches give positions, in code points, without a Python function. Null if there is none.
    """
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if value_group:
        sized = F.zip_with(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), lambda m, v: F.struct(F.length(m).alias("n"), v.alias("value")))
    else:
        sized = F.transform(found, lambda m: F.struct(F.length(m).alias("n"), m.alias("value")))
    # the piece behind the last match has no match
    zipped = F.filter(F.zip_with(sized, pieces, lambda m, gap: F.struct(m["n"].alias("n"), gap.alias("gap"), m["value"].alias("value"))), lambda z: z["n"].isNotNull())
    placed = _scan(zipped, "struct<n:int,gap:int,value:string>", lambda z: z["gap"] + z["n"], lambda x, y: x + y, F.lit(0), "int")
    spans = F.transform(placed, lambda z: F.struct((z["before"] + z["m"]["gap"]).alias("start"), F.lit(rank).alias("rank"), (z["before"] + z["m"]["gap"] + z["m"]["n"]).alias("end"), F.lit(kind).alias("kind"), z["m"]["value"].alias("value")))
    return F.when(text.rlike(pattern), spans)


def _none_to_empty(spans: Column) -> Column:
    return F.coalesce(spans, F.array().cast(f"array<{SPAN}>"))


def _without_inner(spans: Column) -> Column:
    """Sorted spans without the candidates (rank 3) that overlap a base span."""
    after = lambda z: F.when(z["rank"] < 3, z["end"]).otherwise(F.lit(0))
    forth = _scan(spans, SPAN, after, F.greatest, F.lit(0), "int")
    free = F.transform(F.filter(forth, lambda z: (z["m"]["rank"] < 3) | (z["before"] <= z["m"]["start"])), lambda z: z["m"])
    first = lambda z: F.when(z["rank"] < 3, z["start"]).otherwise(F.lit(LONG))
    back = _scan(F.reverse(free), SPAN, first, F.least, F.lit(LONG), "int")
    return F.reverse(F.transform(F.filter(back, lambda z: (z["m"]["rank"] < 3) | (z["before"] >= z["m"]["end"])), lambda z: z["m"]))


def _looks_random(v: Column) -> Column:
    """Mixed classes, as generated keys have them: digits and letters of both cases."""
    return v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, keep: list[str], owner: str = "source") -> DataFrame:
    """``keep`` columns, text hash, ``base`` and ``live`` span arrays and the counts of both verdicts.

    Base spans (assign, access, hex) always stay. Every value, and every further random-looking
    token (kind ``live``), is a candidate: its hash is counted by distinct owners and repositories
    over the whole corpus; a repository is a different text, so copies of a document are one. Owners
    decide first: a value of one owner is owner-specific, hence live-looking, however often that
    owner copies it; a value of more than ``MAX_OWNERS`` owners, or one that several owners share in
    more than ``MAX_SHARED`` repositories, is a widely copied example. Live-looking further tokens become spans.
    Counting is exact: (value, owner, repository) rows are made distinct, which spreads a value that
    half of all documents hold over all tasks, and partial aggregates leave one row for each value,
    owner and task. The text is read once; later steps see hashes and positions, and rows without a
    span take no part in the last join.

    Time is linear in the text and nearly so in its spans. Null or empty text: no spans. Null owner: one more. Equal values in one row count
    once for it. Repeated rows: each gets the same answer; no rows: no rows. A kept column named like
    a result comes back with ``_in`` behind its name.
    """
    results = ["text_hash", "base", "live", "n_owner_specific", "n_copied"]
    there, back = carried(keep, results)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        *there,
        F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("")).alias("owner"),
        F.xxhash64(text).alias("text_hash"),
        text.alias("t"),
    )
    t = F.col("t")
    base = [
        F.filter(_none_to_empty(_spans(t, ASSIGN, "assign", 0, 2)), lambda s: F.length(s["value"]) >= 6),
        _none_to_empty(_spans(t, ACCESS, "access", 1)),
        _none_to_empty(_spans(t, HEX, "hex", 2)),
    ]
    further = _none_to_empty(F.when(t.rlike("[0-9]"), F.filter(_none_to_empty(_spans(t, CANDIDATE, "live", 3)), lambda s: _looks_random(s["value"]))))
    # a further token that overlaps a base span is that span already
    spans = _let(F.concat(*base, further), lambda x: F.when(F.size(x) > 0, _without_inner(F.array_sort(x))).otherwise(x))
    hashed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), F.xxhash64(s["value"]).alias("value")))
    rows = checkpointed(rows.withColumn("spans", hashed).drop("t"))
    rows = rows.withColumn("base", F.filter("spans", lambda s: s["rank"] < 3)).withColumn("x", F.filter("spans", lambda s: s["rank"] == 3)).drop("spans")
    some = rows.where("size(base) > 0 or size(x) > 0")
    found = some.select("owner", "text_hash", F.explode(F.array_distinct(F.transform(F.concat("base", "x"), lambda s: s["value"]))).alias("value")).distinct()
    owners = found.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("r")).groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repositories"))
    owners = checkpointed(owners)  # the joins are then of plain exchanges, whose hot keys can be split
    wide = (F.col("owners") > MAX_OWNERS) | ((F.col("owners") > 1) & (F.col("repositories") > MAX_SHARED))
    verdicts = found.select("text_hash", "value").distinct().join(owners, "value").groupBy(F.col("text_hash").alias("v_hash")).agg(F.collect_list(F.when(~wide, F.col("value"))).alias("own"), F.count(F.when(wide, 1)).alias("n_copied"))
    verdicts = checkpointed(verdicts)
    out = some.join(verdicts, F.col("text_hash") == F.col("v_hash"), "left").drop("v_hash")
    none = rows.where("size(base) = 0 and size(x) = 0").withColumns({"own": F.array().cast("array<bigint>"), "n_copied": F.lit(0).cast("long")})
    out = out.unionByName(none)
    out = out.withColumn("own", F.coalesce("own", F.array().cast("array<bigint>")))
    # own values and tokens sorted together: a token is live-looking if the last value before it is its own
    mark = "struct<value:bigint,token:int,start:int,end:int>"
    none = F.lit(None).cast("bigint")
    owned = F.transform("own", lambda v: F.struct(v.alias("value"), F.lit(0).alias("token"), F.lit(0).alias("start"), F.lit(0).alias("end")))
    tokens = F.transform("x", lambda s: F.struct(s["value"].alias("value"), F.lit(1).alias("token"), s["start"].alias("start"), s["end"].alias("end")))
    seen = _scan(F.array_sort(F.concat(owned, tokens)), mark, lambda m: F.when(m["token"] == 0, m["value"]), lambda a, b: F.coalesce(b, a), none, "bigint")
    live = F.filter(seen, lambda z: (z["m"]["token"] == 1) & (z["m"]["value"] == z["before"]))
    live = F.array_sort(F.transform(live, lambda z: F.struct(z["m"]["start"].alias("start"), F.lit(3).alias("rank"), z["m"]["end"].alias("end"), F.lit("live").alias("kind"), z["m"]["value"].alias("value"))))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:bigint>>")
    out = out.withColumn("live", F.when((F.size("own") > 0) & (F.size("x") > 0), live).otherwise(empty))
    return out.select(*back, "text_hash", "base", "live", F.size("own").cast("long").alias("n_owner_specific"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"))


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = scan(docs, ["doc_id"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "live"))).alias("spans"), "n_owner_specific", "n_copied")


def _sql_spans(pattern: str, kind: str, rank: int, value: str) -> tuple[str, str]:
    """The same positions in DuckDB, from lengths of pieces and matches; and the columns they need."""
    quoted = pattern.replace("'", "''")
    return (
        f"list_transform(range(1, len(m_{kind}) + 1), lambda i: {{'start': coalesce(list_sum(list_transform(g_{kind}[:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m_{kind}[:i - 1], lambda y: length(y))), 0), 'rank': {rank}, "
        f"'end': coalesce(list_sum(list_transform(g_{kind}[:i], lambda y: length(y))), 0) + coalesce(list_sum(list_transform(m_{kind}[:i], lambda y: length(y))), 0), 'kind': '{kind}', 'value': v_{kind}[i]}})"
    ), f"regexp_extract_all(t, '{quoted}') AS m_{kind}, string_split_regex(t, '{quoted}') AS g_{kind}, regexp_extract_all(t, '{quoted}', {value}) AS v_{kind}"


def _op10_sql() -> str:
    parts = {k: _sql_spans(p, k, r, v) for k, p, r, v in (("assign", ASSIGN, 0, "2"), ("access", ACCESS, 1, "0"), ("hex", HEX, 2, "0"), ("live", CANDIDATE, 3, "0"))}
    text = "array_to_string(list_transform({}, lambda s: s.kind || ':' || s.start || ':' || s.end), ',')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, owner, md5(t) AS h, {', '.join(c for _, c in parts.values())} FROM d),
b AS (SELECT doc_id, owner, h, list_sort(list_concat(list_filter({parts['assign'][0]}, lambda s: length(s.value) >= 6), {parts['access'][0]}, {parts['hex'][0]})) AS base,
  list_filter({parts['live'][0]}, lambda s: regexp_matches(s.value, '[0-9]') AND regexp_matches(s.value, '[a-z]') AND regexp_matches(s.value, '[A-Z]')) AS x FROM m),
r AS (SELECT doc_id, owner, h, base, list_filter(x, lambda s: len(list_filter(base, lambda k: k.start < s.end AND s.start < k.end)) = 0) AS x FROM b),
f AS (SELECT DISTINCT owner, h, unnest(list_transform(list_concat(base, x), lambda s: s.value)) AS value FROM r),
w AS (SELECT value, count(DISTINCT owner) > {MAX_OWNERS} OR (count(DISTINCT owner) > 1 AND count(*) > {MAX_SHARED}) AS wide FROM f GROUP BY 1),
v AS (SELECT h, list(value) FILTER (NOT wide) AS own, count(*) FILTER (wide) AS n_copied FROM (SELECT DISTINCT h, value FROM f) JOIN w USING (value) GROUP BY 1),
o AS (SELECT r.*, coalesce(own, []) AS own, coalesce(n_copied, 0) AS n_copied, list_filter(x, lambda s: list_contains(coalesce(own, []), s.value)) AS live FROM r LEFT JOIN v ON v.h = r.h)
SELECT doc_id, len(list_filter(base, lambda s: s.kind = 'assign'))::BIGINT AS n_assign, len(list_filter(base, lambda s: s.kind = 'access'))::BIGINT AS n_access, len(list_filter(base, lambda s: s.kind = 'hex'))::BIGINT AS n_hex,
  sha256({text.format('base')}) AS base_sha256, {text.format('list_sort(list_concat(base, live))')} AS spans, len(own)::BIGINT AS n_owner_specific, n_copied::BIGINT AS n_copied FROM o
"""


OP10_SQL = _op10_sql()


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every base span and every live-looking token replaced by ``mark``; n_chars follows.

    Overlapping spans leave one mark. Rows without a span are returned as they are, null and empty
    texts among them. Rows are matched by id and text hash, so repeated ids with other texts keep
    their own spans, repeated rows get equal texts, and null ids are matched as one id. Columns may
    have any name. No rows: no rows.
    """
    spans = scan(docs, ["doc_id"]).where("size(base) > 0 or size(live) > 0")
    spans = spans.select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), F.array_sort(F.concat("base", "live")).alias("s")).dropDuplicates(["s_id", "s_hash"])
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])  # the text travels once
    rows = docs.select(rest.alias("row"), F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.col("text").alias("t"))
    rows = rows.join(spans, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("h") == F.col("s_hash")), "left")
    # disjoint spans: a span gives up what an earlier one has, and its mark if they touch
    reach = _scan(F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), "struct<start:int,end:int>", lambda x: x["end"], F.greatest, F.lit(0), "int")
    spans = F.transform(
        F.filter(reach, lambda z: z["m"]["end"] > z["before"]),
        lambda z: F.struct(F.greatest(z["m"]["start"], z["before"]).alias("start"), z["m"]["end"].alias("end"), F.when(z["m"]["start"] >= z["before"], F.lit(mark)).otherwise(F.lit("")).alias("mark")),
    )

    def cut(chunks: Column) -> Column:
        # a chunk has the text from its first span (the first chunk: from the start) to the next chunk's
        bounds = F.concat(F.array(F.lit(0)), F.transform(F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0))), lambda c: F.element_at(c, 1)["start"]), F.array(F.lit(LONG)))
        ends = F.slice(bounds, F.lit(2), F.size(chunks))
        parts = F.zip_with(F.zip_with(chunks, F.slice(bounds, F.lit(1), F.size(chunks)), lambda c, a: F.struct(c.alias("c"), a.alias("a"))), ends, lambda x, e: F.struct(x["c"].alias("c"), x["a"].alias("a"), F.substring(F.col("t"), x["a"] + 1, e - x["a"]).alias("part")))
        done = F.transform(
            parts,
            lambda x: F.aggregate(
                x["c"],
                F.struct(x["a"].alias("at"), F.lit("").alias("out")),
                lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(x["part"], acc["at"] - x["a"] + 1, s["start"] - acc["at"]), s["mark"]).alias("out")),
                lambda acc: F.concat(acc["out"], F.substring(x["part"], acc["at"] - x["a"] + 1, F.lit(LONG))),
            ),
        )
        return F.array_join(done, "")

    rows = rows.withColumn("new", F.when(F.col("s").isNotNull(), _let(spans, lambda arr: _let(_chunks(arr, 4 * CHUNK), cut))))

    def value(c: str) -> Column:
        if c == "text":
            return F.when(F.col("s").isNull(), F.col("t")).otherwise(F.col("new"))
        old = F.col("row").getField(c)
        if c == "n_chars":
            return F.when(F.col("s").isNull(), old).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
        return old

    return rows.select(*[value(c).alias(c) for c in docs.columns])
