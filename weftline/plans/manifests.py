"""Manifests and their nested attributes (SRC-2, JSN-2, ARR-1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.plans.base import query
from weftline.plans.scalars import DICE_SQL
from weftline.sources import manifest

# Parts as lines of a manifest. The name is a string, a list of one, or the list of its words; some lines are cut
# off, lack an id, or have a text for attributes.
KIND_SQL = "CASE WHEN p_partkey % 13 = 0 THEN 'malformed' WHEN p_partkey % 17 = 0 THEN 'sample_id' WHEN p_partkey % 19 = 0 THEN 'attributes' ELSE 'good' END"
FIELD_SQL = f"""g AS (SELECT * FROM part WHERE {KIND_SQL} = 'good'),
f AS (SELECT p_partkey::VARCHAR AS sample_id, 'brand' AS field, [p_brand] AS v FROM g UNION ALL SELECT p_partkey::VARCHAR, 'item.type', [p_type] FROM g
UNION ALL SELECT p_partkey::VARCHAR, 'item.name', CASE p_size % 3 WHEN 2 THEN string_split(p_name, ' ') ELSE [p_name] END FROM g
UNION ALL SELECT p_partkey::VARCHAR, 'item.make.size', [p_size::VARCHAR] FROM g UNION ALL SELECT p_partkey::VARCHAR, 'extra', CASE WHEN p_size % 5 = 0 THEN [] ELSE [p_type, p_brand] END FROM g)"""


def lines(t):
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    name = F.when(F.col("p_size") % 3 == 0, quoted("p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("["), quoted("p_name"), F.lit("]"))).otherwise(F.to_json(F.split("p_name", " ")))
    extra = F.when(F.col("p_size") % 5 == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), quoted("p_type"), F.lit(", null, "), quoted("p_brand"), F.lit("]")))
    nested = F.concat(F.lit('{"brand": '), quoted("p_brand"), F.lit(', "item": {"type": '), quoted("p_type"), F.lit(', "name": '), name, F.lit(', "make": {"size": '), F.col("p_size").cast("string"), F.lit('}}, "extra": '), extra, F.lit(', "empty": {}}'))
    key = F.col("p_partkey")
    attributes = F.when(key % 19 == 0, F.lit('"none"')).otherwise(nested)
    line = F.concat(F.lit('{"sample_id": "'), F.when(key % 17 == 0, F.lit("")).otherwise(key.cast("string")), F.lit('", "attributes": '), attributes, F.when(key % 13 == 0, F.lit("")).otherwise(F.lit("}")))
    return t.part.select(line.alias("value"))


def fields(t):
    return manifest.flatten(manifest.parse_manifest(lines(t)).where("reason is null"), "sample_id")


@query("src_2_manifest", f"SELECT {KIND_SQL} AS reason, count(*) AS n, count(*) FILTER ({KIND_SQL} NOT IN ('malformed', 'sample_id')) AS named FROM part GROUP BY 1")
def _(t):
    """Lines by what is wrong with them."""
    return manifest.parse_manifest(lines(t)).groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("sample_id") != "", 1)).alias("named"))


@query("jsn_2_flatten", f"WITH {FIELD_SQL} SELECT sample_id, field, len(v)::INT AS n, array_to_string(v, '|') AS joined FROM f")
def _(t):
    return fields(t).select("sample_id", "field", F.size("values").alias("n"), F.array_join("values", "|").alias("joined"))


@query("arr_1_list_values", f"WITH {FIELD_SQL}, b AS (SELECT sample_id, field, v, list_distinct([lower(trim(x)) FOR x IN v IF lower(trim(x)) NOT IN ('unknown', 'none', 'no', '')]) AS w FROM f WHERE field IN ('item.name', 'extra')) SELECT sample_id, field, len(w)::INT AS n, round(coalesce(list_max([" + DICE_SQL.format(a="regexp_extract_all(x, '[a-z0-9]+')", b="['red', 'ring']") + " FOR x IN w]), 0), 6)::DOUBLE AS s FROM b")
def _(t):
    """Values of a field, string or list alike, scored by the best-matching element."""
    rows = fields(t).where(F.col("field").isin("item.name", "extra")).withColumn("w", X.normalise_values(F.col("values")))
    return rows.select("sample_id", "field", F.size("w").alias("n"), F.round(X.best_element(F.col("w"), F.lit("red ring")), 6).alias("s"))
