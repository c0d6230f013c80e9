"""Whitening, centroid clustering and license scans against brute force and on odd rows."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import centroids, licenses, registry, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, n long, cluster string, `a.b` int"


def odd_vectors(dims):
    """Copies, a null id, and every kind of vector that takes no part."""
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.standard_normal(dims).astype(np.float32)], 7, "c", 1) for i in range(40)]
    bad = [None, [], [None] * dims, [NAN] * dims, [INF] + [0.0] * (dims - 1), [1.0] * (dims - 1), [3e38] + [0.0] * (dims - 1)]
    return good + good[:9] + [good[0]] * 30 + [(None, good[1][1], None, None, None)] + [(100 + i, v, 7, "c", 1) for i, v in enumerate(bad)]


def usable(rows, dims):
    return [r for r in rows if r[1] is not None and len(r[1]) == dims and all(c is not None and np.isfinite(c) and abs(c) < 1e30 for c in r[1])]


# -- 11 whitening ----------------------------------------------------------------------------------


def whitened(x, k):
    """Dense: mean, deviation and projections on the eigenvectors of the covariance of the distinct rows."""
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ q / np.sqrt(e), e / (y * y).sum() * n


def test_whitening_against_dense_eigenvectors(spark):
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r["embedding"] is not None]
    got = {(r["vec_id"], r["component"]): r for r in registry.QUERIES["op11_whitening"](spark, SF).collect()}
    x = np.floor(np.array([r["embedding"] for r in rows], dtype=np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    n, deviation, w, explained = whitened(x, 16)
    mine = np.array([[got[r["vec_id"], c]["whitened"] for c in range(1, 17)] for r in rows])
    assert np.abs(mine - w * np.sign((mine * w).sum(axis=0))).max() < 1e-8 and len(got) == 16 * len(rows)
    first = [got[r["vec_id"], 1] for r in rows]
    assert [r["deviation"] for r in first] == deviation.tolist() and {r["n"] for r in first} == {n}
    assert np.allclose([got[rows[0]["vec_id"], c]["explained"] for c in range(1, 17)], explained, rtol=1e-9)
    assert max(r["identity_error"] for r in first) < 1e-9


@pytest.mark.parametrize(("dims", "kind"), [(300, "flat"), (300, "falling"), (500, "close"), (64, "flat"), (9, "flat"), (1, "flat"), (40, "rank 3"), (40, "zero")])
def test_subspace_iteration_finds_leading_components(dims, kind):
    rng = np.random.default_rng(dims)
    y = rng.standard_normal((900, dims))
    if kind == "falling":
        y = y * 0.97 ** np.arange(dims)
    if kind == "close":
        y = y * np.where(np.arange(dims) < 16, 1.05, 1.0)
    if kind == "rank 3":
        y = y[:, :3] @ rng.standard_normal((3, dims))
    a = y.T @ y / 900 * (kind != "zero")
    e, q, passes = whitening.subspace(lambda m: a @ m, dims, min(16, dims))
    k = len(e)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-11 * max(e[0], 1))
    assert np.linalg.norm(a @ q - q * e) < 1e-10 * max(e[0], 1) and np.allclose(q.T @ q, np.eye(k)) and passes < 80


def test_whitening_of_odd_rows(spark):
    rows = odd_vectors(20)
    df = spark.createDataFrame(rows, VECTORS)
    got = whitening.whiten(df, ["vec_id", "n", "a.b"], k=4).collect()
    good = usable(rows, 20)
    assert len(got) == len(good) and set(got[0].asDict()) == {"vec_id", "n_in", "a.b", "n", "deviation", "whitened", "explained", "identity_error"}
    x = np.floor(np.array([r[1] for r in good], dtype=np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    n, deviation, w, _ = whitened(x, 4)
    assert n == 40 and sorted(r["deviation"] for r in got) == sorted(deviation.tolist())
    assert np.allclose(sorted(abs(r["whitened"][0]) for r in got), sorted(abs(w[:, 0])))


def test_whitening_of_few_rows(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<double>")
    assert [(r["n"], r["deviation"], r["whitened"]) for r in whitening.whiten(one, ["vec_id"]).collect()] == [(1, 0, [])] * 2
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {len(r["whitened"]) for r in whitening.whiten(line, ["vec_id"]).collect()} == {1}
    for rows in ([], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), ["vec_id"]).collect() == []
    far = spark.createDataFrame([(i, [float(i % 3) * 2.0**38, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whiten(far, ["vec_id"]).collect()
    assert {r["deviation"] for r in got} == {0, None}  # too large for a long away from the mean


# -- 12 centroids ----------------------------------------------------------------------------------


def lloyd(x, order, k=8, rounds=10):
    at = x[sorted(range(len(x)), key=lambda i: (order[i], x[i].tolist()))[:k]]
    for r in range(rounds + 1):
        d = ((x[:, None] - at[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)  # the first of equals
        if r < rounds:
            at = np.array([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else at[j] for j in range(len(at))])
    return own, d.min(axis=1), at


def test_exponion_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{SF}/embeddings.parquet'")
    want = con.sql(centroids.OP12_SQL)
    got = registry.QUERIES["op12_centroids"](spark, SF)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_exponion_keeps_ties_and_empty_clusters(spread):
    """On a coarse grid most vectors lie as near to one centroid as to another, and centroids coincide."""
    rng = np.random.default_rng(spread)
    x = rng.integers(-spread, spread + 1, (800, 3))
    at = x[rng.integers(0, 800, 12)]
    own, upper, lower, layout = np.zeros(800, "<i4"), np.full(800, np.inf), np.zeros(800), centroids.Layout(at)
    work = 0
    for _ in range(12):
        own, upper, lower, more = centroids.assign(x, own, upper, lower, layout)
        d = ((x[:, None] - at[None]) ** 2).sum(axis=2)
        assert (own == d.argmin(axis=1)).all()
        work += more
        new = np.array([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else at[j] for j in range(12)])
        at, layout = new, centroids.Layout(new, at)
    assert spread < 1000 or work < 0.5 * 12 * 12 * 800


def test_clusters_of_odd_rows(spark):
    rows = odd_vectors(64)
    df = spark.createDataFrame(rows, VECTORS)
    order = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    got = centroids.cluster(df, ["vec_id", "cluster", "a.b"], order, rounds=9).collect()
    good = usable(rows, 64)
    x = np.floor(np.array([r[1] for r in good], dtype=np.float32).astype(float) * 1024).astype(np.int64)
    key = [hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest() for r in good]
    own, d, at = lloyd(x, key, rounds=9)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in got) == sorted((str(r[0]), int(o), int(v)) for r, o, v in zip(good, own, d, strict=True))
    assert {r["inertia"] for r in got} == {int(d.sum())} and {r["cluster_in"] for r in got} == {"c", None}
    assert {tuple(r["centroid"]) for r in got} == {tuple(at[j].tolist()) for j in set(own.tolist())}


def test_clusters_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [0.5])]):
        assert centroids.cluster(spark.createDataFrame(rows, schema), ["vec_id"], F.col("vec_id")).collect() == []
    same = spark.createDataFrame([(i, [0.25] * 64) for i in range(20)], schema)
    assert {(r["cluster"], r["distance"], r["inertia"]) for r in centroids.cluster(same, ["vec_id"], F.col("vec_id")).collect()} == {(0, 0, 0)}
    two = spark.createDataFrame([(0, [0.0] * 64), (1, [-1.0] * 64)], schema)
    assert {r["vec_id"]: r["cluster"] for r in centroids.cluster(two, ["vec_id"], F.col("vec_id")).collect()} == {0: 0, 1: 1}


# -- 13 licenses -----------------------------------------------------------------------------------


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_base(text):
    w = brute_words(text)
    hits = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in hits]
    return len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def brute_labels(text):
    """Labels of notices by regular expressions: a phrase that starts inside a longer one says nothing of its own."""
    w = f" {' '.join(brute_words(text))} "
    hits = sorted((m.start(), -len(p), label) for phrases in (licenses.BASE, licenses.NOTICES) for p, label in phrases.items() for m in re.finditer(f"(?= {p} )", w))
    out, reach, last = {x for p, x in licenses.BASE.items() if f" {p} " in w}, -1, -1
    for start, size, label in hits:
        if start != last and start - size > reach:
            out.add(label)
        last, reach = start, max(reach, start - size)
    return ",".join(sorted(out))


def test_licenses_of_all_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = registry.QUERIES["op13_licenses"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(texts[r["doc_id"]])
        assert r["labels"] == brute_labels(texts[r["doc_id"]]) and 0 <= r["score"] <= 1


def test_licenses_against_brute_force():
    rng = random.Random(1)
    words = "cc by nc sa general public license all rights reserved CC-BY Lesser apache version 2 0 é É 　 ... \x00 mit bsd clause affero".split(" ")
    machine = licenses.automaton()
    for _ in range(4000):
        text = rng.choice([" ", "-", " . "]).join(rng.choice(words) for _ in range(rng.randrange(0, 16)))
        got = licenses.scan_text(text, machine)
        assert got[:5] == brute_base(text) and got[5] == brute_labels(text), text


def value(text):
    return licenses.evaluate(licenses.postfix(text))


def test_expressions():
    assert licenses.postfix("MIT or (GPL-2.0-only with Classpath-exception-2.0 and BSD-3-Clause)") == ["MIT", "GPL-2.0-only", "Classpath-exception-2.0", "with", "BSD-3-Clause", "and", "or"]
    assert value("MIT OR GPL-3.0+") == (0.1, {"mit", "gpl"}) and value("MIT AND GPL-3.0+")[0] == 0.7
    assert value("MIT OR GPL-3.0 AND AGPL-3.0")[0] == 0.1 and value("(MIT OR GPL-3.0) AND AGPL-3.0")[0] == 0.8  # and binds tighter
    assert value("GPL-2.0 WITH Classpath-exception-2.0") == (0.35, {"gpl"})
    assert value("LicenseRef-own") == (0.6, {"other"}) and value("") == (0.0, set())
    # what breaks off: the part before it counts
    for text in ("MIT and", "( MIT", "MIT )", "MIT GPL-2.0", "MIT (", "MIT, see file", "MIT or )"):
        assert licenses.postfix(text) == ["MIT"], text
    assert licenses.postfix("((A or B) and C") == ["A", "B", "or", "C", "and"] and licenses.postfix("or MIT") == []


def test_random_expressions_against_recursion():
    """Python's own grammar as the judge: and binds tighter than or, parentheses as they stand."""
    rng = random.Random(5)

    class V(float):
        def __or__(self, x):
            return V(min(self, x))

        def __and__(self, x):
            return V(max(self, x))

    rates = {"MIT": 0.1, "GPL-2.0": 0.7, "MPL-2.0": 0.4, "AGPL-3.0": 0.8}

    def make(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice([*rates])
        inner = f" {rng.choice(['and', 'or'])} ".join(make(depth - 1) for _ in range(rng.randrange(2, 4)))
        return f"({inner})" if rng.random() < 0.6 else inner

    for _ in range(500):
        text = make(4)
        code = re.sub(r"[A-Z][\w.-]*", lambda m: f"V({rates[m[0]]})", text).replace("and", "&").replace("or", "|")
        assert value(text)[0] == eval(code, {"V": V}), text


def test_tags_in_texts():
    machine = licenses.automaton()
    got = licenses.scan_text("// SPDX-License-Identifier: Apache-2.0 OR MIT\r\ncode mit\n# spdx-license-identifier: GPL-2.0-only spdx license identifier BSD-3-Clause", machine)
    assert got[5:] == ("apache-2.0,bsd,gpl,mit", 0.7, ["Apache-2.0 MIT or", "GPL-2.0-only", "BSD-3-Clause"])
    assert licenses.scan_text("GNU Lesser General Public License", machine)[4:7] == ("gpl", "gpl,lgpl", 0.5)
    assert licenses.scan_text("spdx license identifier", machine)[5:] == ("", 0.0, [])


def test_licenses_of_odd_rows(spark):
    schema = "doc_id long, text string, labels string, n_words int, `a.b` int"
    long = "All rights reserved. cc by " * 30_000
    rows = [(1, None, "x", 1, 1), (2, "", "x", 1, 1), (2, "", "x", 1, 1), (None, "cc by", None, None, None), (3, long, "x", 1, 1)]
    got = licenses.scan(spark.createDataFrame(rows, schema), ["doc_id", "labels", "n_words", "a.b"]).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"], r["score"], r["labels_in"]))
    assert by[1] == [(0, 0, None, None, "", 0.0, "x")] and by[2] == by[1] * 2 and by[None] == [(2, 1, 0, 0, "cc-by", 0.2, None)]
    assert by[3] == [(150_000, 60_000, 0, 149_998, "cc-by,reserved", 1.0, "x")]
    assert licenses.scan(spark.createDataFrame([], schema), ["doc_id"]).collect() == []
