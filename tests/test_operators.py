"""Operators on tiny frames: dedup gates, splits, graphs, assignment, runs, sources."""

import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import assign, dedup, graph, splits
from weftline.session import with_prefix
from weftline.sources import io


@pytest.mark.parametrize(("d", "c", "near"), [(8, 0.0, True), (12, 0.88, True), (12, 0.5, False), (40, 1.0, False)])
def test_hamming_gate(spark, d, c, near):
    assert spark.range(1).select(dedup.near(F.lit(d), F.lit(c), dedup.ISOLATION).alias("x")).first()["x"] is near


def test_hamming_bands_find_all(spark):
    rng = random.Random(3)
    a = rng.getrandbits(62)
    for radius in (0, 3, 15):
        flips = rng.sample(range(63), radius)
        b = a
        for f in flips:
            b ^= 1 << f
        if b >= 2**63:
            continue
        x = spark.createDataFrame([(a, b)], "a long, b long").select(F.arrays_overlap(dedup.hamming_bands(F.col("a"), radius), dedup.hamming_bands(F.col("b"), radius)).alias("x"))
        assert x.first()["x"]


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000 + i) for i in range(1, 60)]
    root = {}

    def top(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            p, q = top(a), top(b)
            root[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: top(i) for i in root}


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_prefix_sums(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id", (F.col("id") % 7).alias("w"))
    got = with_prefix(rows, ["k", "id"], F.col("w")).collect()
    total = 0
    for r in sorted(got, key=lambda r: (r["k"], r["id"])):
        assert r["prefix"] == total
        total += r["w"]


def test_grouped_split_keeps_groups(spark):
    g = spark.createDataFrame([(i, 1 + i % 5) for i in range(100)], "g long, n long")
    s = splits.grouped_split(g, "g", share=0.2).collect()
    total, test = sum(r["n"] for r in s), sum(r["n"] for r in s if r["split"] == "test")
    assert len(s) == 100 and total * 0.15 < test <= total * 0.2


def test_allocate_rounds_to_total(spark):
    q = splits.allocate(spark.createDataFrame([("a", 1000), ("b", 900), ("c", 400), ("d", 300), ("e", 200)], "s string, n long"), "s", 1000).collect()
    assert sum(r["quota"] for r in q) == 1000
    assert {r["s"]: r["quota"] for r in q if r["s"] in "ab"} == {"a": 250, "b": 250}


def test_assignment_is_optimal(spark):
    m = spark.createDataFrame([("f", 0, 0, 0.9), ("f", 0, 1, 0.8), ("f", 1, 0, 0.85), ("f", 1, 1, 0.1)], "frame string, i int, j int, s double")
    assert {(r["i"], r["j"]) for r in assign.assign(m, "frame").collect()} == {(0, 1), (1, 0)}


def brute_pairs(s):
    m, n = s.shape
    if m <= n:
        options = (tuple(enumerate(p)) for p in permutations(range(n), m))
    else:
        options = (tuple(sorted(zip(p, range(n), strict=True))) for p in permutations(range(m), n))
    return list(min(options, key=lambda o: (-round(sum(s[x] for x in o), 9), o)))


def test_assignment_against_brute_force():
    rng = np.random.default_rng(6)
    for k in range(400):
        s = rng.integers(0, (3, 50)[k % 2], rng.integers(1, 7, 2)) / 7
        assert assign.best_pairs(s) == brute_pairs(s)


def test_assignment_is_optimal_in_large_frames(spark):
    # greedy takes the 0.9 of each pair of items and is left with 0.1
    rows = [("f", 2 * b + i, 2 * b + j, s) for b in range(6) for i, j, s in ((0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.85), (1, 1, 0.1))]
    got = assign.assign(spark.createDataFrame(rows, "frame string, i int, j int, s double"), "frame").collect()
    assert {(r["i"], r["j"]) for r in got} == {(2 * b + i, 2 * b + 1 - i) for b in range(6) for i in (0, 1)}
    s = np.random.default_rng(7).integers(0, 4, (8, 8)) / 3
    assert assign.best_pairs(s) == brute_pairs(s)


def test_greedy_set(spark):
    df = spark.createDataFrame([("x", i) for i in range(4)], "b string, id long")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    assert {r["id"] for r in dedup.greedy_independent(df, "id", e).where("kept").collect()} == {0, 2}


def test_greedy_set_against_a_visit_in_order(spark):
    rng = np.random.default_rng(3)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (120, 2)) if a != b}
    near = {i: {a + b - i for a, b in pairs if i in (a, b)} for i in range(60)}
    kept = set()
    for i in range(60):
        kept |= set() if near[i] & kept else {i}
    got = dedup.greedy_independent(spark.range(60), "id", spark.createDataFrame([*pairs], "a long, b long"))
    assert {r["id"] for r in got.where("kept").collect()} == kept and got.count() == 60
    assert dedup.greedy_independent(spark.range(3), "id", spark.createDataFrame([], "a long, b long")).where("kept").count() == 3


def test_quantiles_and_ranks_in_groups(spark):
    from weftline.operators import metrics, splits

    rng = np.random.default_rng(4)
    rows = [("g" if i % 3 else None, float(v)) for i, v in enumerate(rng.integers(0, 40, 500))] + [("one", 7.0), ("g", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["a"], r["b"]) for r in metrics.quantiles(df, "g", "v", {"a": 0.5, "b": 0.95}).collect()}
    for g in ("g", None, "one"):
        v = [x for h, x in rows if h == g and x is not None]
        assert got[g] == pytest.approx((np.quantile(v, 0.5), np.quantile(v, 0.95)))
    ranked = splits.rank_in_group(df.where("v is not null").withColumn("id", F.monotonically_increasing_id()), ["g"], [F.col("v"), F.col("id")], "rk").collect()
    for g in ("g", None, "one"):
        own = sorted((r["rk"], r["v"], r["id"]) for r in ranked if r["g"] == g)
        assert [o[0] for o in own] == list(range(1, len(own) + 1)) and [o[1:] for o in own] == sorted(o[1:] for o in own)


def test_runs_and_caches(spark):
    todo = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert {r["id"] for r in io.pending(todo, spark.createDataFrame([(2,)], "id long"), "id").collect()} == {1, 3}
    problems = {r["id"]: r["problem"] for r in io.id_check(todo, spark.createDataFrame([(1,), (1,), (9,), (2,)], "id long"), "id").collect()}
    assert problems == {1: "duplicated", 3: "missing", 9: "unexpected"}
    idx = {r["id"]: (r["idx"], r["worker"]) for r in io.round_robin(todo, "id", 2).collect()}
    assert idx == {1: (0, 0), 2: (1, 1), 3: (2, 0)}


def test_frames_manifest_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"frame_id": "f1", "scene": "s", "regions": [{"bbox": {"x1": 0, "y1": 0, "x2": 2, "y2": 3}, "description": "a", "status": "ok"}]}')
    (tmp_path / "in" / "b.json").write_text('{"frame_id": "f2", "scene": "s", "regions": []}')
    rows = {r["frame_id"]: r for r in io.read_frames(spark, str(tmp_path / "in")).collect()}
    assert rows["f1"]["sample_id"] == "s/f1#0" and rows["f2"]["sample_id"] is None
    (tmp_path / "m.jsonl").write_text('{"sample_id": "x", "attributes": {"c": ["red"]}}\nnot json\n')
    good, bad = io.read_manifest(spark, str(tmp_path / "m.jsonl"))
    assert [r["sample_id"] for r in good.collect()] == ["x"] and bad.count() == 1
    before = io.fingerprints(spark, str(tmp_path / "in"))
    kept = before.collect()
    assert io.changed(before, spark.createDataFrame(kept, before.schema)).count() == 0
    io.write_immutable(good, str(tmp_path / "out"))
    with pytest.raises(Exception):
        io.write_immutable(good, str(tmp_path / "out"))
    assert "x" in io.markdown_report(good.select("sample_id")) and "<td>x</td>" in io.html_report(good.select("sample_id"), "t")


def test_png_sizes(spark, tmp_path):
    import struct

    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"\0" * 9)
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF" + b"\0" * 10 + b"\xff\xff\xc2" + struct.pack(">HBHHB", 17, 8, 333, 777, 3) + b"\0" * 9)
    (tmp_path / "d.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 12, 34))
    (tmp_path / "e.bmp").write_bytes(b"BM" + b"\0" * 16 + struct.pack("<ii", 50, -60))
    (tmp_path / "f.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    got = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"]) for r in io.image_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (640, 480), "b.txt": (None, None), "c.jpg": (777, 333), "d.gif": (12, 34), "e.bmp": (50, 60), "f.jpg": (None, None)}


def test_stream_resumes(spark, tmp_path):
    from weftline.streaming import windows

    path, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.sql("select timestamp_ntz'2024-01-01 00:00:00' ts, 1L user_id, 'a' event_type, 1.0D value").write.parquet(path)
    read = lambda: windows.read_events(spark, path).select("user_id", "value")
    windows.run_available(read(), out, mark)
    windows.run_available(read(), out, mark)
    assert spark.read.parquet(out).count() == 1
    spark.sql("select timestamp_ntz'2024-01-01 00:01:00' ts, 2L user_id, 'b' event_type, 1.0D value").write.mode("append").parquet(path)
    windows.run_available(read(), out, mark)
    assert spark.read.parquet(out).count() == 2


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).collect()) > 0


def test_lists_csv_and_summaries(spark, tmp_path):
    (tmp_path / "split.txt").write_text("a.jpg a.json red\nb.jpg b.json\n")
    got = {r["image"]: r["color_label"] for r in io.read_split_list(spark, str(tmp_path / "split.txt")).collect()}
    assert got == {"a.jpg": "red", "b.jpg": None}
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.25)], "image string, tp int, miou double")
    io.write_csv(rows, str(tmp_path / "m.csv"))
    assert {tuple(r) for r in io.read_csv(spark, str(tmp_path / "m.csv"), "image string, tp int, miou double").collect()} == {("a", 1, 0.5), ("b", 2, 0.25)}
    status = spark.createDataFrame([("ok",), ("ok",), ("failed",), ("skipped",)], "status string")
    assert io.summary_json(io.run_summary(status)) == '{"failed": 1, "processed": 2, "selected": 4, "skipped": 1}'
    assert io.large_files(spark, str(tmp_path), 5).count() >= 1
    io.write_scored(rows.withColumn("candidate", F.lit("base")), str(tmp_path / "scored"))
    assert spark.read.parquet(str(tmp_path / "scored")).where("candidate = 'base'").count() == 2
    io.snapshot(rows, str(tmp_path / "snap"), "1")
    with pytest.raises(Exception):
        io.snapshot(rows, str(tmp_path / "snap"), "1")


def test_service_seam_and_shards(spark):
    def client(b):
        b["answer"] = b["id"] * 2
        return b

    rows = spark.range(20)
    got = io.call_service(rows, client, "id long, answer long", workers=3).collect()
    assert {(r["id"], r["answer"]) for r in got} == {(i, 2 * i) for i in range(20)}
    assert io.shard(rows, "id", 4).select("shard").distinct().count() <= 4
    assert [r["id"] for r in io.bounded_rows(rows.orderBy("id"))] == list(range(20))


def test_service_retries_and_times_out(spark, tmp_path):
    mark = str(tmp_path / "tried")

    def flaky(b):
        import os

        if not os.path.exists(mark):
            open(mark, "w").close()
            raise OSError("not yet")
        return b.assign(answer="ok")

    rows = spark.range(4)
    got = io.call_service(rows, flaky, "id long, answer string", workers=1, wait=0.01).collect()
    assert len(got) == 4 and {r["answer"] for r in got} == {"ok"}

    def slow(b):
        import time

        time.sleep(1.0)
        return b.assign(answer="late")

    late = io.call_service(rows, slow, "id long, answer string", workers=1, timeout=0.05, retries=1, wait=0.01, failed=lambda b, e: b.assign(answer=type(e).__name__)).collect()
    assert {r["answer"] for r in late} == {"TimeoutError"} and len(late) == 4
    with pytest.raises(Exception, match="not today"):
        io.call_service(rows, lambda b: (_ for _ in ()).throw(ValueError("not today")), "id long", workers=1, retries=0).collect()


def test_row_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "i int, s string")
    b = spark.createDataFrame([("y", 2), ("x", 1)], "s string, i int")
    assert io.row_digest(a).first() == io.row_digest(b).first()
    assert io.row_digest(a).first() != io.row_digest(a.where("i = 1")).first()
