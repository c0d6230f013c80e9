"""Manifests with nested attributes that hold strings or lists alike."""

import json

from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.sources import io, manifest

ROWS = [
    {"sample_id": "s/f#0", "attributes": {"age_group": "adult", "gender": "female", "upper_garment": {"type": "coat", "color": ["red"], "length": "long"}, "lower_garment": {"type": "skirt", "color": ["black", "white"], "length": None}}},
    {"sample_id": "s/f#1", "bbox_xyxy": [1.5, 2, 3, 4], "attributes": {"hair": "long", "shoes": {"type": "boots", "color": "brown"}, "carried_items": {"handbag": "no", "backpack": "yes"}, "head": {"accessories": ["hat", None, "mask"]}, "extra": []}},
    {"sample_id": "s/f#2", "attributes": {"handheld_items": {"dangerous_item": False, "mobile_phone": 1}, "a": {"b": {"c": {"d": [1.5, {"e": 2}]}}}, "extra": ["scarf", "badge"], "none": {}}},
    {"sample_id": "s/f#3"},
    {"sample_id": "s/f#4", "attributes": None},
]
BAD = ['{"sample_id": "x", "attributes": {"a": 1, "a": 2}}', '{"sample_id": "x", "attributes": ["a"]}', '{"sample_id": "x", "attributes": "a"}', '{"attributes": {}}', '{"sample_id": " "}', "[1]", "{", '{"sample_id": "x", "bbox_xyxy": "no"}']


def test_nested_attributes_come_out_long(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n".join([*map(json.dumps, ROWS), *BAD, ""]))
    good, bad = io.read_manifest(spark, str(tmp_path / "m.jsonl"))
    assert sorted(r["sample_id"] for r in good.collect()) == [r["sample_id"] for r in ROWS]
    assert good.where("sample_id = 's/f#1'").first()["bbox_xyxy"] == [1.5, 2.0, 3.0, 4.0]
    assert sorted((r["reason"], r["value"]) for r in bad.collect()) == sorted(zip(["malformed", "attributes", "attributes", "sample_id", "sample_id", "malformed", "malformed", "malformed"], BAD, strict=True))
    long = manifest.flatten(good, "sample_id")
    got = {(r["sample_id"][-1], r["field"]): r["values"] for r in long.collect()}
    assert got == {
        ("0", "age_group"): ["adult"], ("0", "gender"): ["female"], ("0", "upper_garment.type"): ["coat"], ("0", "upper_garment.color"): ["red"], ("0", "upper_garment.length"): ["long"],
        ("0", "lower_garment.type"): ["skirt"], ("0", "lower_garment.color"): ["black", "white"], ("0", "lower_garment.length"): [],
        ("1", "hair"): ["long"], ("1", "shoes.type"): ["boots"], ("1", "shoes.color"): ["brown"], ("1", "carried_items.handbag"): ["no"], ("1", "carried_items.backpack"): ["yes"], ("1", "head.accessories"): ["hat", "mask"], ("1", "extra"): [],
        ("2", "handheld_items.dangerous_item"): ["false"], ("2", "handheld_items.mobile_phone"): ["1"], ("2", "a.b.c.d"): ["1.5", '{"e":2}'], ("2", "extra"): ["scarf", "badge"],
    }
    assert len(got) == 19
    scored = long.select("field", X.best_element(X.normalise_values(F.col("values")), F.lit("white")).alias("s"), X.normalise_values(F.col("values")).alias("v"))
    by = {r["field"]: r for r in scored.collect()}
    assert by["lower_garment.color"]["s"] == 1.0 and by["upper_garment.color"]["s"] == 0.0 and by["carried_items.handbag"]["v"] == []


def test_depth_and_round_trip(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps(ROWS[2]))
    good, _ = io.read_manifest(spark, str(tmp_path / "m.jsonl"))
    assert {r["field"]: r["values"] for r in manifest.flatten(good, "sample_id", depth=2).collect()}["a.b"] == ['{"c":{"d":[1.5,{"e":2}]}}']
    io.write_jsonl(good, str(tmp_path / "out"))
    again, bad = io.read_manifest(spark, str(tmp_path / "out"))
    assert bad.count() == 0 and sorted(map(str, manifest.flatten(again, "sample_id").collect())) == sorted(map(str, manifest.flatten(good, "sample_id").collect()))
    none, _ = io.read_manifest(spark, str(tmp_path / "m.jsonl"))
    assert manifest.flatten(none.where("false"), "sample_id").count() == 0


def test_flatten_scans_once_without_shuffle(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text(json.dumps(ROWS[0]))
    good, _ = io.read_manifest(spark, str(tmp_path / "m.jsonl"))
    plan = manifest.flatten(good, "sample_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Python" not in plan
