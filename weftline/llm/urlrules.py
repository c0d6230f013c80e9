"""URL filters: a sort-merge range join of reversed-host keys with nested rules."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import carried

#: Rules that a task may hold; beyond it the rules are joined by key instead.
MOST_HELD = 200_000
#: The rules of the registered query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
UPPER_CASE, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER = str.maketrans(UPPER_CASE, LOWER_CASE)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.lit(2**31 - 1)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1), UPPER_CASE, LOWER_CASE), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(h: Column) -> Column:
    """``a.example.org`` -> ``org.example.a.``: a host and its subdomains share a prefix, others don't."""
    return F.concat(F.array_join(F.reverse(F.split(h, r"\.", -1)), "."), F.lit("."))


def sweep(keys: list[str], paths: list[str], rules: list[tuple[str, list[tuple[str, str, str]]]], names: list[str]) -> Iterator[tuple[str, str] | None]:
    """The (rule, verdict) of each sorted key, or None; ``rules`` sorted by key, each with its paths; ``names`` are their keys.

    A rule's key opens an interval that holds exactly the keys starting with it. Intervals nest, so
    one pass over both sorted lists keeps the open ones on a stack; the innermost host with a
    fitting path wins, there the longest path.
    """
    stack: list[tuple[str, list[tuple[str, str, str]]]] = []
    at = bisect_left(names, keys[0]) if keys else 0
    for n in (i + 1 for i, c in enumerate(keys[0] if keys else "") if c == "."):  # rules open before the first key
        i = bisect_left(names, keys[0][:n], 0, at)
        if i < at and names[i] == keys[0][:n]:
            stack.append(rules[i])
    for key, p in zip(keys, paths, strict=True):
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        best = None
        for _, own in reversed(stack):
            best = next(((rule, verdict) for prefix, rule, verdict in own if p.startswith(prefix)), None)
            if best:
                break
        yield best


def grouped(rules: list[tuple[str, str, str]]) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """Rules by reversed-host key in key order, each with its paths, longest first."""
    by: dict[str, dict[str, tuple[str, str, str]]] = {}
    for h, p, verdict in rules:
        h = h.translate(LOWER)
        own = by.setdefault(".".join(reversed(h.split("."))) + ".", {})
        own[p] = max(own.get(p, (p, h + p, verdict)), (p, h + p, verdict))
    # as the sorted rows have it: code unit order of UTF-8 is code point order, and so is Python's
    return [(k, sorted(v.values(), key=lambda r: (-len(r[0]), r[0]))) for k, v in sorted(by.items())]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, keep: list[str], url: str = "url", default: str = DEFAULT) -> DataFrame:
    """``keep`` columns, host, path, rule (or null) and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's. The longest host
    wins, then the longest path; of equal rules the one with the greatest verdict in code point order
    (block before allow), so the order of rules is of no account; null parts make no rule. Urls are sorted by reversed host and path
    over all partitions (a hot host spreads over as many as it needs), then swept against the rules.
    ``rules`` (a list, or a DataFrame of host, path, verdict) are held by each task up to MOST_HELD;
    more are joined on every suffix of the host instead, with the same result.
    Null urls and urls without ``://``: host and path empty, no rule. Repeated rows: equal answers.
    No rows: no rows; no rules: the default everywhere. A kept column named like a result comes back
    with ``_in`` behind its name.
    """
    there, back = carried(keep, ["host", "path", "rule", "verdict"])
    rows = pages.select(*there, host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"))
    if isinstance(rules, DataFrame):
        rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
        some = rules.limit(MOST_HELD + 1).collect()
        if len(some) > MOST_HELD:
            return _joined(rows, rules, back, default)
        rules = [tuple(r) for r in some]
    elif len(rules) > MOST_HELD:
        return _joined(rows, pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string").dropna(), back, default)
    held = grouped([r for r in rules if None not in r])
    names = [k for k, _ in held]
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64(*[f"k_{i}" for i in range(len(keep))])
    rows = rows.withColumn("key", reversed_host(F.col("host"))).withColumn("_spread", spread)
    rows = rows.repartitionByRange(n, "key", "path", "_spread").sortWithinPartitions("key", "path")
    out = rows.drop("_spread", "key").schema.add("rule", "string").add("verdict", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(sweep(batch.pop("key").tolist(), batch["path"].tolist(), held, names))
            batch = batch.drop(columns="_spread")
            batch["rule"] = [f[0] if f else None for f in found]
            batch["verdict"] = [f[1] if f else default for f in found]
            yield batch

    done = rows.mapInPandas(run, out)
    return done.select(*back, "host", "path", "rule", "verdict")


def _joined(rows: DataFrame, rules: DataFrame, back: list[Column], default: str) -> DataFrame:
    """The way for rule tables of any size: an equi-join on each suffix of the host."""
    urls = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.translate("host", UPPER_CASE, LOWER_CASE).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    near = urls.withColumn("r_host", F.explode(suffixes)).join(r, "r_host").where(F.col("path").startswith(F.col("r_path")))
    best = near.groupBy("host", "path").agg(F.max(F.struct(F.length("r_host").alias("a"), F.length("r_path").alias("b"), "r_host", "r_path", "r_verdict")).alias("m"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(*back, "host", "path", F.concat("m.r_host", "m.r_path").alias("rule"), F.coalesce("m.r_verdict", F.lit(default)).alias("verdict"))


def op9_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES, ["page_id"])


OP9_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT h.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(r_host) DESC NULLS LAST, length(r_path) DESC) AS n
      FROM h LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
