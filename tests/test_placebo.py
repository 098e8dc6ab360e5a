"""Permutation thresholds and placebo runs against plain recounts; NULL keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.config import EffectConfig
from causeway.operators import estimate, robust
from causeway.operators.joins import caches, keep
from causeway.operators.nuisance.strata import strata_nuisance

P = 2 ** 31 - 1


def plain_keys(h, run, seed=42):
    c = robust.key_constants(seed)

    def coef(name):
        m, o = c[name]
        v = (run + 1) * m + o
        return v % P if name.startswith("c") else v % (P - 1) + 1

    a, b = h & (2 ** 30 - 1), (h >> 30) & (2 ** 30 - 1)
    return ((coef("a1") * a + coef("b1") * b + coef("c1")) % P) * 2 ** 31 + (coef("a2") * a + coef("b2") * b + coef("c2")) % P


def panel(spark, n=1500, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n) * 3 + 40
    t = (rng.random(n) < 0.3).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "t": t, "x": x, "z": rng.normal(size=n), "y": 2 * x + t + rng.normal(size=n),
                        "fold": rng.integers(0, 3, n), "g": np.where(np.arange(n) % 10 == 0, "small", "big")})
    df = spark.createDataFrame(pdf).withColumn("t", F.col("t").cast("int"))
    return df.withColumn("g", F.when(F.col("g") != "big", F.col("g"))), pdf    # the larger group is NULL


@pytest.mark.parametrize("width", [6.0, 0.01])
def test_thresholds_are_exact_and_a_miss_widens_the_window(spark, width, monkeypatch):
    df, pdf = panel(spark)
    picks = []
    plain = robust._window_picks
    monkeypatch.setattr(robust, "_window_picks", lambda *a: (picks.append(a[-1]), plain(*a))[1])
    got = robust.permutation_thresholds(df, 8, 42, width=width)
    assert (len(picks) > 1) == (width < 1)          # 0.01 deviations hold the threshold in few runs
    from causeway.functions.hashing import md5_int

    h0 = [r[0] for r in df.select(md5_int("id", "perm42")).collect()]
    for run in range(8):
        keys = sorted((plain_keys(h, run), i) for h, i in zip(h0, pdf.id))
        assert got[run] == keys[int(pdf.t.sum()) - 1]


@pytest.mark.parametrize("width", [6.0, 0.01])
def test_permutations_keep_the_treated_count_in_every_group(spark, width):
    df, pdf = panel(spark)
    got = robust.permuted(df, 12, 42, ["x"], ["g"], width=width).groupBy("g", "run").agg(
        F.count("*").alias("n"), F.sum("t").alias("n1")).collect()
    want = {None: (1350, int(pdf.t[pdf.g == "big"].sum())), "small": (150, int(pdf.t[pdf.g == "small"].sum()))}
    assert len(got) == 24 and all((r.n, r.n1) == want[r.g] for r in got)


def test_window_rows_are_few(spark):
    """What is shuffled for the thresholds: about 12 deviations of a rank per run, not the rows."""
    df, pdf = panel(spark, 20_000)
    low, high = robust._window(F.lit(20_000), F.lit(int(pdf.t.sum())), 6.0)
    keyed = robust._runs(df, range(5), ["id"], 42)
    inside = keyed.where(F.col("_h").between(low, high)).groupBy("run").count().collect()
    bound = 2 * (6 * (20_000 * 0.3 * 0.7) ** 0.5 + 6)
    assert all(r["count"] < 1.3 * bound < 1200 for r in inside)


def test_a_group_without_treated_rows_has_no_threshold(spark):
    df = spark.range(40).select("id", F.lit(0).alias("t"), (F.col("id") % 2).alias("fold"), F.lit(1.0).alias("y"))
    assert robust.permutation_thresholds(df, 3, 42) == {}
    rows = robust.permuted(df.withColumn("g", F.col("id") % 3), 2, 42, ["y"], ["g"])
    assert rows.agg(F.sum("t")).first()[0] == 0


def plain_linear(pdf, t, xcols, cfg):
    """Per-fold least squares of the propensity and both arms, two covariates and all."""
    x = np.column_stack([np.ones(len(pdf))] + [pdf[c] for c in xcols])
    e, m1, m0 = (np.zeros(len(pdf)) for _ in range(3))
    for f in sorted(pdf.fold.unique()):
        tr, te = (pdf.fold != f).to_numpy(), (pdf.fold == f).to_numpy()
        fit = lambda rows, y: np.linalg.lstsq(x[rows], y[rows], rcond=None)[0]
        e[te] = x[te] @ fit(tr, t)
        m1[te], m0[te] = (x[te] @ fit(tr & (t == a), pdf.y.to_numpy()) for a in (1, 0))
    e = np.clip(np.clip(e, cfg.trim, 1 - cfg.trim), *cfg.ps_clip)
    y = pdf.y.to_numpy()
    psi = t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e) + m1 - m0
    att = np.mean(t * (y - m0) - (1 - t) * e / (1 - e) * (y - m0)) / t.mean()
    w = 4 * e * (1 - e)
    return psi.mean(), att, (w * psi).sum() / w.sum()


def test_linear_placebo_equals_refits(spark):
    df, pdf = panel(spark, 600)
    cfg = EffectConfig(n_splits=3)
    got = {r.run: r for r in robust.placebo_linear_runs(df, ["x", "z"], cfg, 6).collect()}
    drawn = robust.permuted(df, 6, cfg.seed, ["fold"]).toPandas()
    for run in range(6):
        t = drawn[drawn.run == run].sort_values("id").t.to_numpy()
        want = plain_linear(pdf, t, ["x", "z"], cfg)
        assert np.allclose([got[run].ate, got[run].att, got[run].ato], want, rtol=1e-7, atol=1e-9)


def test_linear_placebo_in_groups_and_with_odd_columns(spark):
    """A constant, a copied and a NULL covariate, a NULL group: the fit falls back, rows stay."""
    df, pdf = panel(spark, 600)
    odd = df.withColumn("one", F.lit(1.0)).withColumn("copy", F.col("x")).withColumn("none", F.lit(None).cast("double"))
    cfg = EffectConfig(n_splits=3)
    got = robust.placebo_linear_runs(odd, ["x", "one", "copy", "none"], cfg, 3, ("y",), ["g"]).collect()
    assert len(got) == 6 and {r.n for r in got} == {540, 60}
    plain = robust.placebo_linear_runs(df.where("g IS NULL"), ["x"], cfg, 3).collect()
    want = {r.run: r.ate for r in plain}
    assert all(abs(r.ate - want[r.run]) < 1e-6 for r in got if r.g is None)


def test_solve_stack_falls_back():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(20), rng.normal(size=20) + 1e3, rng.normal(size=20)])
    y = x @ [1.0, 2.0, 3.0]
    few, flat = x[:3], np.column_stack([x, x[:, 1]])
    assert np.allclose(robust.solve_stack((x.T @ x)[None], (x.T @ y)[None])[0], [1, 2, 3], atol=1e-6)
    assert np.allclose(robust.solve_stack((few.T @ few)[None], (few.T @ y[:3])[None])[0], [y[:3].mean(), 0, 0])
    assert np.allclose(flat @ robust.solve_stack((flat.T @ flat)[None], (flat.T @ y)[None])[0], y, atol=1e-4)
    assert (robust.solve_stack(np.zeros((1, 3, 3)), np.zeros((1, 3))) == 0).all()


def test_null_cells_lose_no_row(spark):
    df, pdf = panel(spark, 900)
    df = df.withColumn("cell", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("int")))
    cfg = EffectConfig(n_splits=3)
    nuis = strata_nuisance(df, "cell", cfg)
    assert nuis.where("psi IS NULL").count() == 0
    assert estimate.effect_table(nuis, "ATE", cfg).first()["n"] == 900
    runs = robust.placebo_runs(df.withColumn("c2", F.col("cell")), "c2", cfg, 2)
    assert {r.n for r in runs.collect()} == {900}


def test_caches_are_released(spark):
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    with caches(spark):
        df = keep(spark.range(10))
        assert df.count() == 10 and len(spark.sparkContext._jsc.getPersistentRDDs()) > before
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
