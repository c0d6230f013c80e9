"""Manifests as they are: JSON lines whose attributes are nested and hold strings or lists alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``attributes`` stays a VARIANT: no schema fits values that are a string in one row and a list in the next.
MANIFEST_SCHEMA = (
    "schema_version string, sample_id string, split string, task string, image string, prompt string, label string, scene string, session string, scale string, "
    "bbox_xyxy array<double>, bbox_loc_0_999 array<int>, attributes variant, _corrupt string"
)
#: Levels of nesting that become dotted names.
DEPTH = 8


def is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def is_list(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Lines (column ``value``) with the fields of the manifest and ``reason``: null for a good row.

    Reasons: ``malformed`` (no JSON object, a field of another type, a key twice in an object),
    ``sample_id`` (none or an empty one), ``attributes`` (present, but no object). Blank lines are malformed.
    """
    row = F.from_json("value", MANIFEST_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    r = lines.select("value", row.alias("r"))
    a = F.col("r.attributes")
    reason = (
        F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull() | (F.trim("value") == ""), F.lit("malformed"))
        .when(F.coalesce(F.trim("r.sample_id"), F.lit("")) == "", F.lit("sample_id"))
        .when(a.isNotNull() & ~F.is_variant_null(a) & ~is_object(a), F.lit("attributes"))
    )
    return r.select("value", "r.*", reason.alias("reason")).drop("_corrupt")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined lines with their reason) of a JSONL manifest with the explicit schema."""
    # the raw line is kept so that a bad row can be looked at, and no second read is needed
    parsed = parse_manifest(spark.read.text(path))
    return parsed.where("reason is null").drop("value", "reason"), parsed.where("reason is not null").select("value", "reason")


def values_of(v: Column) -> Column:
    """A scalar as a list of one, a list as its elements, all as strings; JSON nulls are left out, objects inside a list stay JSON."""
    elements = F.transform(v.cast("array<variant>"), lambda e: e.cast("string"))
    return F.filter(F.when(is_list(v), elements).otherwise(F.array(v.cast("string"))), lambda s: s.isNotNull())


def flatten(rows: DataFrame, key: str, attributes: str = "attributes", depth: int = DEPTH) -> DataFrame:
    """(key, field, values): one row for each leaf of a nested VARIANT, with its dotted name and a list of strings.

    Each level is one generator over the rows of the last, without a shuffle or a second scan; leaves
    pass through. An absent or null VARIANT and an empty object give no field, a null or empty leaf an
    empty list; objects below ``depth`` levels stay JSON texts. Order inside a list is kept.
    """
    spark = rows.sparkSession
    at = rows.where(F.col(attributes).isNotNull()).select(F.col(key).alias("k"), F.lit(None).cast("string").alias("field"), F.col(attributes).alias("v"))
    for _ in range(depth):
        inner = spark.tvf.variant_explode_outer(F.when(is_object(F.col("v").outer()), F.col("v").outer()))
        name = F.when(F.col("key").isNotNull(), F.concat_ws(".", "field", "key")).otherwise(F.col("field"))
        at = at.lateralJoin(inner).select("k", name.alias("field"), F.coalesce("value", "v").alias("v"))
    leaves = at.where(F.col("field").isNotNull() & (F.schema_of_variant("v") != "OBJECT<>"))
    return leaves.select(F.col("k").alias(key), "field", values_of(F.col("v")).alias("values"))
