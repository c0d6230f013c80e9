"""Steps that must not grow faster than their input."""

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.operators import metrics, splits


def test_rows_of_equal_values_enter_the_cover_once(spark, monkeypatch):
    """Copies of a row cannot gain: the rounds see each set of values once, under its smallest key."""
    seen = []
    real = splits.checkpointed
    monkeypatch.setattr(splits, "checkpointed", lambda df: seen.append(real(df)) or seen[-1])
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit("a"), F.lit("b"), F.lit(None))).when(F.col("id") % 3 == 1, F.array(F.lit("b"), F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("b"), F.lit("c"))).alias("v"))
    assert {tuple(r) for r in splits.coverage_order(rows, "id", "v").collect()} == {(0, 2), (2, 1)}
    assert seen[0].count() == 4


def test_keywords_are_counted_before_the_join(spark):
    rows = spark.createDataFrame([("x", "a wall, a Wall and more"), ("x", "wall"), ("y", "more"), (None, "wall"), ("y", None)], "g string, t string")
    words = spark.createDataFrame([("wall",), ("tree",), ("wall",)], "w string")
    got = metrics.keyword_counts(rows, ["g"], "t", words, "w")
    assert {(r["g"], r["w"], r["n"]) for r in got.collect()} == {("x", "wall", 2), (None, "wall", 1)}


def test_refused_rows_cost_one_more_call_a_batch(spark, tmp_path, monkeypatch):
    from weftline.plans import exchange, registry

    kept = {}
    monkeypatch.setattr(exchange.io, "call_service", lambda rows, client, schema, **k: kept.update(client=client, failed=k["failed"]) or rows)
    spark.range(50).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("t").alias("p_type"), F.col("id").cast("int").alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    batch = registry.QUERIES["src_8_service"](spark, str(tmp_path)).toPandas()
    with pytest.raises(ValueError):
        kept["client"](batch)
    groups = []
    monkeypatch.setattr(type(batch), "groupby", lambda *a, **k: groups.append(a) or pytest.fail("row by row"))
    got = kept["failed"](batch, ValueError())
    assert dict(zip(got["p_partkey"], got["answer"], strict=True)) == {k: "failed" if k == 13 else "a t n" for k in range(50)}


@pytest.mark.parametrize("most", [1024, 3])
def test_regions_of_a_frame_meet_without_a_join_of_pairs(spark, tmp_path, monkeypatch, most):
    """As the SQL has it, with null names and hot frames; a plan of one join, unless frames are hot."""
    from weftline.plans import ranking, registry

    monkeypatch.setattr(ranking, "MOST_REGIONS", most)
    names = ["red ring", "Red bolt", "blue cap of tin", "", None, "ring", "!", "red ring bolt"]
    spark.range(60).select(F.col("id").alias("p_partkey"), F.get(F.array(*[F.lit(n) for n in names]), (F.col("id") % 8).cast("int")).alias("p_name"), F.lit(1).alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    lines = spark.range(400).select(F.when(F.col("id") < 360, F.floor(F.sqrt(F.col("id") * 3))).alias("l_orderkey"), F.pmod(F.xxhash64("id"), F.lit(61)).alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), F.col("id").cast("int").alias("l_linenumber"), F.lit(2.0).alias("l_extendedprice"))
    lines.unionByName(spark.range(5).select(F.lit(7).cast("long").alias("l_orderkey"), "id", F.lit(2).cast("long").alias("l_suppkey"), F.lit(500).alias("l_linenumber"), F.lit(1.0).alias("l_extendedprice")).withColumnRenamed("id", "l_partkey")).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = registry.QUERIES["agg_18_region_rates"](spark, str(tmp_path))
    db = duckdb.connect()
    for table in ("part", "lineitem"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = db.execute(registry.ORACLE_SQL["agg_18_region_rates"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 5
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert most == 3 or plan.count("Join ") == 1


def test_shared_tokens_need_no_shuffle_of_words(spark):
    """A row counts what its two texts share; rows of one key count together, as do those with a null in it."""
    words = lambda n, w: F.array_repeat(F.lit(w), n)
    rows = spark.range(6).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.lit(9)).alias("k"), F.col("id").alias("kept"), F.concat(words(3, "x"), words(2, "y")).alias("a"), F.when(F.col("id") != 2, F.concat(words(2, "x"), words(5, "z"))).alias("b"))
    once = metrics.token_overlap(rows.where("k < 4"), ["k"], "a", "b", ["kept"])
    assert sorted(tuple(r) for r in once.collect()) == [(k, 5, None if k == 2 else 7, 0 if k == 2 else 2, k) for k in range(4)]
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "Join" not in plan
    assert sorted(tuple(r) for r in metrics.token_overlap(rows, ["k"], "a", "b", ["kept"]).collect())[-2:] == [(9, 5, 7, 4, 4), (9, 5, 7, 4, 5)]
    null = rows.select(F.lit(None).cast("long").alias("k"), "a", "b").limit(2)
    assert [tuple(r) for r in metrics.token_overlap(null, ["k"], "a", "b").collect()] == [(None, 5, 7, 4)] * 2


def test_text_quality_with_repeated_turns(spark, tmp_path):
    """Turns that occur more than once, null texts and roles: as the SQL has it."""
    from weftline.plans import registry

    rows = [(1, 1, "user", "a b a c"), (1, 2, "assistant", "a a d"), (1, 2, "assistant", "b d"), (1, 3, "user", None), (2, 1, "user", ""), (2, 2, None, "x"), (2, 3, "user", "x x"), (None, 1, "user", "q"), (3, 1, "user", "One"), (3, 2, "user", "one TWO")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("agg_20_text_quality", "str_2_word_f1"):
        got, want = registry.QUERIES[name](spark, str(tmp_path)).collect(), db.execute(registry.ORACLE_SQL[name]).fetchall()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
