"""Whitening, exact top-k search and periodic runs against plain recounts."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import catalog, periodic_runs, topk_search, whitening
from causeway.llm.vectors import pack, unpack


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v])
                                  for i, v in rows], f"vec_id long, embedding array<{kind}>")


# ------------------------------------------------------------ packing
def test_pack_round_trip():
    rows = [np.array([1, -5, 2 ** 31 - 1]), np.array([2 ** 31, 0]), np.zeros(0, np.int64), np.array([-2 ** 63])]
    got = unpack([pack(r) for r in rows], 3)
    assert got.tolist() == [[1, -5, 2 ** 31 - 1], [2 ** 31, 0, 0], [0, 0, 0], [-2 ** 63, 0, 0]]


# ------------------------------------------------------------ whitening
def plain_whitening(rows, k=16):
    """Eigenvectors of the covariance of the distinct floor(64 c)."""
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)) for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, mean = len(fit), fit.mean(axis=0)
    e, v = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    keep = [j for j in np.argsort(-e) if e[j] > 1e-9 * e.max()][:k]
    return n, fit, {i: (r - mean) @ v[:, keep] / np.sqrt(e[keep]) for i, r in x.items()}, e[keep] / e.sum()


def check_whitening(spark, rows, k=16):
    n, fit, want, explained = plain_whitening(rows, k)
    got = whitening.whiten(vectors(spark, rows), k).collect()
    k = len(explained)
    assert len(got) == len(rows) * k
    table = {i: np.zeros(k) for i, _ in rows}
    sums = [int(s) for s in fit.sum(axis=0)]
    for r in got:
        table[r.vec_id][r.component - 1] = r.whitened
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    sign = np.sign(sum(table[i] * want[i] for i, _ in rows))
    for i, v in rows:
        assert np.abs(table[i] * sign - want[i]).max() < 1e-7
        x = [int(c) for c in np.floor(64 * np.array(v, np.float32).astype(float))]
        assert {r.deviation for r in got if r.vec_id == i} == {sum((n * c - s) ** 2 for c, s in zip(x, sums))}


@pytest.mark.parametrize("dims", [3, 12, 40])
def test_whitening_equals_eigenvectors(spark, dims):
    rng = np.random.default_rng(dims)
    x = rng.standard_normal((150, dims)) * np.linspace(4, 1, dims)
    x[::3] = x[0]  # a hot vector counts once
    check_whitening(spark, [(i, v.tolist()) for i, v in enumerate(x)])


def test_whitening_of_low_rank_and_few_rows(spark):
    rng = np.random.default_rng(1)
    low = np.floor(rng.standard_normal((80, 3)) * 5) @ np.floor(rng.standard_normal((3, 9)) * 3)
    check_whitening(spark, [(i, v.tolist()) for i, v in enumerate(low)])
    check_whitening(spark, [(i, v) for i, v in enumerate([[1.0, 2, 3, 4], [0, 0, 1, 5], [2, 2, 2, 2]])])


def local_product(x):
    def product(z, earlier):
        p = x @ z
        return np.concatenate([x.T @ p, [p @ p], (x @ earlier).T @ p])
    return product


def test_bidiagonalisation_sees_every_copy_of_a_repeated_deviation():
    """An early stop misses nothing: equal deviations in several directions."""
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    u = np.linalg.qr(rng.standard_normal((300, 60)))[0]
    s = np.concatenate([[5, 5, 5, 3], np.geomspace(1, 1e-6, 56)])
    x = (u * s) @ q
    got, vecs, _ = whitening.bidiagonalise(local_product(x), 60, 4, [], 3)
    found = list(vecs)
    more, _, _ = whitening.bidiagonalise(local_product(x), 60, 1, found, 4, 1e-8)
    assert np.allclose(got, s[:4]) or more[0] > got[3] * 1.001  # what is missing shows in the proof run
    s = np.geomspace(1, 1e-5, 60)
    got, vecs, complete = whitening.bidiagonalise(local_product((u * s) @ q), 60, 8, [], 3)
    assert not complete and np.allclose(got, s[:8], rtol=1e-12)
    assert np.allclose(np.abs((vecs * q[:8]).sum(axis=1)), 1, atol=1e-10)


def test_fit_recovers_repeated_deviations(spark):
    """A cross polytope: all deviations are equal, whatever the start."""
    eye = np.eye(6)
    rows = [(i, (8 * v).tolist()) for i, v in enumerate([*eye, *-eye])]
    got = whitening.whiten(vectors(spark, rows)).toPandas()
    assert got.component.max() == 6 and np.allclose(got.explained, 1 / 6)
    w = got.sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(12, 6)
    assert np.allclose(w.T @ w / 12, np.eye(6))


def test_whitening_defined_cases(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1, 2]), (2, [1, 2])])).collect() == []  # no variance
    assert whitening.whiten(vectors(spark, [(1, []), (2, [])])).collect() == []
    odd = vectors(spark, [(1, None), (2, [1, None]), (3, [1, float("nan")]), (4, [1, float("inf")]), (None, [1, 2]),
                          (5, [2, 5]), (5, [2, 5]), (6, [3, 1]), (7, [4])]).withColumn("n", F.lit("x")).withColumn("v", F.lit(1))
    got = whitening.whiten(odd).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted(
        (i, c) for i in (0, 5, 5, 6, 7) for c in (1, 2))
    assert {r.n for r in got} == {4}  # [4] counts as [4, 0]
    huge = whitening.whiten(vectors(spark, [(1, [1e30, 0]), (2, [0, 1]), (3, [0, 2])])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and any(r.deviation is None for r in huge)


# ------------------------------------------------------------ top-k
def plain_top(rows, k=5, scale=256):
    width = max((len(v) for _, v in rows), default=0)
    x = [[int(np.floor(scale * float(np.float32(c)))) for c in v] + [0] * (width - len(v)) for _, v in rows]
    out = []
    for i, (q, _) in enumerate(rows):
        if q is None or q % 50:
            continue
        best = sorted(((-sum(a * b for a, b in zip(x[i], x[j])), rows[j][0] if rows[j][0] is not None else 2 ** 63)
                       for j in range(len(rows)) if j != i))[:k]
        out += [(q, r + 1, v if v < 2 ** 63 else None, -s) for r, (s, v) in enumerate(best)]
    return sorted(out, key=str)


def check_top(spark, rows):
    got = topk_search.top_k(vectors(spark, rows).withColumn("score", F.lit("x")), F.col("vec_id") % 50 == 0)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_top(rows)


def test_top_k_of_lengths_that_differ_much(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SLAB", 150)
    monkeypatch.setattr(topk_search, "BUCKET", 40)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 6)) * np.exp(rng.standard_normal((900, 1)) * 1.5)
    check_top(spark, [(i, v.tolist()) for i, v in enumerate(x)])


def test_top_k_with_hot_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((400, 3)))
    x[::3] = x[0]
    x[1::7] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, [1, 1]), (50, [1, 1]), (None, [3, 3, 3]), (350, [])]
    check_top(spark, rows)


def test_top_k_defined_cases(spark):
    assert topk_search.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert topk_search.top_k(vectors(spark, [(1, [1, 2])]), F.col("vec_id") % 50 == 0).collect() == []
    assert topk_search.top_k(vectors(spark, [(0, [1, 2])]), F.col("vec_id") % 50 == 0).collect() == []
    rows = [(0, [1, 2]), (1, None), (2, [1, None]), (3, [float("nan"), 1]), (4, [float("-inf"), 1]), (5, [0, 3])]
    got = topk_search.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, 2 * 3 * 65536)]
    top = 2 ** 63 - 1  # scores beyond a long are held
    got = topk_search.top_k(vectors(spark, [(0, [1e30, 1]), (1, [1e30, 2]), (2, [-1e30, 0])]), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, top), (0, 2, 2, -top - 1)]


def test_coordinate_pruning_is_used_and_loses_nothing():
    """Clustered directions: high cosine thresholds, so ranges prune."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 8))
    x = np.unique(np.round(100 * (centres[rng.integers(0, 30, 3000)] + 0.02 * rng.standard_normal((3000, 8)))).astype(np.int64), axis=0)
    norms = np.linalg.norm(x, axis=1)
    o = np.argsort(-norms)
    x, norms = x[o], norms[o]
    used = []
    plain = topk_search._by_coordinates
    topk_search._by_coordinates = lambda *a: (used.append(r := plain(*a)), r)[1]
    try:
        q, score, _ = topk_search.search(x[::40], norms[::40], np.zeros(len(x[::40]), np.int64),
                                         np.zeros(len(x[::40]), bool), x, norms, np.arange(len(x)), 6)
    finally:
        topk_search._by_coordinates = plain
    assert sum(r is not None for r in used) >= 10
    want = -np.sort(-(x[::40] @ x.T), axis=1)[:, :6]
    assert [score[q == i].tolist() for i in range(len(want))] == want.tolist()


# ------------------------------------------------------------ periodic runs
def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        j = 0
        while j + q < n:
            if w[j] != w[j + q]:
                j += 1
                continue
            s = j
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - s + q
            if size >= max(6, 4 * q) and not any(
                    all(w[i] == w[i + d] for i in range(s, s + size - d)) for d in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(w):
    runs = plain_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def made_words(rng, n):
    k = rng.choice([1, 2, 3, 6, 40])
    w = [f"w{rng.randrange(k)}" for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 8:
            a, p = rng.randrange(n), rng.randint(1, max(1, n // 5))
            for i in range(a + p, min(n, a + p * rng.randint(2, 8) + rng.randrange(3))):
                w[i] = w[i - p]
    return w


def test_transform_finds_zero_mismatches():
    rng = np.random.default_rng(6)
    for length in (1, 2, 8, 64):
        blocks = rng.integers(1, 4, (20, length))
        windows = rng.integers(0, 4, (20, 2 * length))
        for i in range(10):
            at = rng.integers(0, length)
            windows[i, at:at + length] = blocks[i]
        want = np.array([[(b == w[d:d + length]).all() for d in range(length)] for b, w in zip(blocks, windows)])
        assert (periodic_runs.zero_mismatch(blocks, windows) == want).all() and want.any()


def test_runs_equal_plain_search(spark, monkeypatch):
    rng = random.Random(7)
    words = [made_words(rng, rng.choice([0, 3, 6, 30, 90, 200])) for _ in range(300)]
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(w)) for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:8] for r in periodic_runs.periodic_runs(df).collect()}
    assert got == {i: plain_row(w) for i, w in enumerate(words)}
    monkeypatch.setattr(periodic_runs, "CELLS", 64)  # transforms in many pieces
    ids = {w: i for i, w in enumerate(sorted({w for x in words for w in x}))}
    for w in words[:100]:
        assert periodic_runs.find_runs(np.array([ids[x] for x in w], np.int64)) == plain_runs(w)


def test_colliding_codes_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_codes", lambda ids, length: ids % 2 + 1)
    rng = random.Random(8)
    for _ in range(150):
        w = [int(x[1:]) for x in made_words(rng, rng.choice([20, 60, 130]))]
        assert periodic_runs.find_runs(np.array(w, np.int64)) == plain_runs(w)


def test_query_plants_runs(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:8] for r in catalog.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        w = (text or "").encode().split()
        w = [x.decode() for x in w]
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        if n <= 1500:
            assert got[i] == plain_row(w), i


def test_runs_defined_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a a a a a a"), (3, "a a a a a"), (3, "x " * 9), (3, "x " * 9),
                                (4, "           ")],
                               "doc_id long, text string").withColumn("n_runs", F.lit("x")).withColumn("start", F.lit(1))
    got = sorted((r.doc_id or 0, r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in
                 periodic_runs.periodic_runs(df).collect())
    assert got == sorted([(0, 1, 0, 6, 1, 6000), (1, 0, None, None, None, None), (2, 0, None, None, None, None),
                          (3, 0, None, None, None, None), (3, 1, 0, 9, 1, 9000), (3, 1, 0, 9, 1, 9000),
                          (4, 1, 0, 6, 1, 6000)], key=lambda r: (r[0], r[1]))
    assert periodic_runs.periodic_runs(df.limit(0)).collect() == []


def test_runs_of_very_long_texts(spark):
    """Two texts of megabytes: one word, and a long phrase five times."""
    rng = random.Random(9)
    phrase = [f"w{rng.randrange(500)}" for _ in range(70_000)]
    rows = [(1, "a " * 400_000), (2, " ".join(["z"] + phrase * 5 + ["z"]))]
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_runs, got[1].length, got[1].period) == (1, 400_000, 1)
    assert (got[2].n_runs, got[2].start, got[2].length, got[2].period) == (1, 1, 350_000, 70_000)
