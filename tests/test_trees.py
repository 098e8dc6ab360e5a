"""Trees grown together against one-by-one recounts; little bags; degenerate arms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.config import EffectConfig
from causeway.operators import hte, trees
from causeway.operators.nuisance.arms import ArmRules, arm_status, route_arms
from causeway.operators.nuisance.forest import forest_nuisance


def plain_tree(x, y, depth, min_leaf, cuts):
    """Greedy splits at given cut points (x: rows x features) → function of rows."""
    def fit(rows, level):
        mean = y[rows].mean()
        best = None
        if level < depth:
            for f in range(x.shape[1]):
                for c in cuts[f]:
                    left = rows[x[rows, f] <= c]
                    if min_leaf <= len(left) <= len(rows) - min_leaf:
                        s, sl = y[rows].sum(), y[left].sum()
                        gain = sl ** 2 / len(left) + (s - sl) ** 2 / (len(rows) - len(left)) - s ** 2 / len(rows)
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, f, c)
        if best is None or best[0] <= 1e-12 * max(1, abs(y[rows].sum())):
            return lambda r: mean
        _, f, c = best
        a, b = fit(rows[x[rows, f] <= c], level + 1), fit(rows[x[rows, f] > c], level + 1)
        return lambda r: a(r) if r[f] <= c else b(r)

    return fit(np.arange(len(y)), 0)


def frame(spark, n=1200, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 10, n), "b": rng.normal(size=n), "t": rng.integers(0, 2, n),
                        "fold": rng.integers(0, 3, n)})
    pdf["y"] = np.round(20 * (pdf.a > 4) + 10 * pdf.t * (pdf.b > 0) + rng.normal(size=n) * 4)
    return spark.createDataFrame(pdf), pdf


def test_every_fold_and_arm_equals_its_own_tree(spark):
    df, pdf = frame(spark)
    cuts = [list(range(10)), [-1.0, -0.5, 0.0, 0.5, 1.0]]
    fam = [trees.Family("e", F.col("t")), trees.Family("m1", F.col("y"), F.col("t") == 1), trees.Family("m0", F.col("y"), F.col("t") == 0)]
    forest = trees.grow(df, ["a", "b"], fam, [0, 1, 2], depth=3, min_leaf=15, cuts=cuts)
    got = trees.predict(df, forest).toPandas().sort_values("id")
    x = pdf[["a", "b"]].to_numpy(float)
    for name, y, mask in (("e", pdf.t, pdf.t >= 0), ("m1", pdf.y, pdf.t == 1), ("m0", pdf.y, pdf.t == 0)):
        for f in range(3):
            tr = (mask & (pdf.fold != f)).to_numpy()
            fit = plain_tree(x[tr], y[tr].to_numpy(float), 3, 15, cuts)
            mine = (pdf.fold == f).to_numpy()
            assert np.allclose(got[name][mine], [fit(r) for r in x[mine]])


def test_growth_runs_one_aggregate_per_level(spark, monkeypatch):
    """Passes follow the depth, not the number of folds, families and trees."""
    df, _ = frame(spark, 300)
    calls = []
    plain = trees._histograms
    monkeypatch.setattr(trees, "_histograms", lambda *a: (calls.append(a[1]), plain(*a))[1])
    fam = [trees.Family("e", F.col("t")), trees.Family("m", F.col("y"))]
    trees.grow(df, ["a", "b"], fam, [0, 1, 2], depth=3, min_leaf=5, trees=8, mtry=1)
    assert calls == [0, 1, 2]


def test_missing_features_constant_targets_and_empty_models(spark):
    df, _ = frame(spark, 200)
    df = df.withColumn("a", F.when(F.col("id") % 4 > 0, F.col("a"))).withColumn("flat", F.lit(3.0)) \
        .withColumn("none", F.lit(None).cast("double")).withColumn("y2", F.col("a").isNull().cast("double") * 5)
    fam = [trees.Family("miss", F.col("y2")), trees.Family("same", F.col("flat")), trees.Family("void", F.col("none"))]
    forest = trees.grow(df, ["a", "none"], fam, depth=2, min_leaf=5)
    got = trees.predict(df, forest).toPandas()
    assert np.allclose(got.miss, got.y2)            # missing values are a bin of their own
    assert (got["same"] == 3).all() and got.void.isna().all()
    assert trees.predict(df.limit(0), forest).count() == 0
    rules = forest.rules("miss")
    assert len(rules) == 2 and rules[0]["conditions"][0]["threshold"] == float("-inf")


def test_sampled_forest_is_repeatable(spark):
    df, _ = frame(spark, 400)
    fam = [trees.Family("m", F.col("y"))]
    cuts = [list(range(10)), [-1.0, 0.0, 1.0]]
    one = trees.grow(df, ["a", "b"], fam, [0, 1, 2], depth=3, trees=6, bags=3, mtry=1, cuts=cuts)
    two = trees.grow(df.repartition(7), ["a", "b"], fam, [0, 1, 2], depth=3, trees=6, bags=3, mtry=1, cuts=cuts)
    assert (one.feature == two.feature).all() and np.allclose(one.value, two.value)
    assert not (one.feature[:, 0] == one.feature[:, 5]).all()
    with pytest.raises(ValueError):
        trees.grow(df, ["a"], fam, trees=5, bags=3)


def test_bag_spread_takes_out_the_noise_of_few_trees():
    rng = np.random.default_rng(1)
    bags, per, rows = 2000, 4, 50
    each = rng.normal(size=(bags, 1, rows)) * 2.0 + rng.normal(size=(bags, per, rows)) * 3.0
    sd = trees.bag_spread(each.reshape(-1, rows), per)
    assert abs(sd.mean() - 2.0) < 0.1
    assert np.isnan(trees.bag_spread(each.reshape(-1, rows)[:4], 4)).all()


def test_intervals_cover_planted_effects(spark):
    """90 % intervals of planted effects over 20 seeds cover 87 to 93 % of the rows' effects."""
    covered = total = 0
    for seed in range(20):
        rng = np.random.default_rng(100 + seed)
        n = 3200
        pdf = pd.DataFrame({"id": np.arange(n) + 10_000 * seed, "a": rng.integers(0, 16, n), "e": 0.5, "fold": rng.integers(0, 2, n)})
        pdf["true"] = 6.0 * pdf.a
        pdf["psi"] = pdf.true + rng.normal(size=n) * 6
        got = hte.effect_intervals(spark.createDataFrame(pdf), ["a"], None, bags=100, per_bag=2, max_depth=4, min_leaf=5,
                                   bins=32).toPandas()
        covered += int(((got.lb90 <= got.true) & (got.true <= got.ub90)).sum())
        total += n
    assert 0.87 <= covered / total <= 0.93, covered / total


def test_forest_nuisance_finds_the_effect(spark):
    rng = np.random.default_rng(3)
    n = 4000
    x = rng.normal(size=n)
    t = (rng.random(n) < 1 / (1 + np.exp(-x))).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "x": x, "t": t, "y": 3 * x + 2.0 * t + rng.normal(size=n), "fold": rng.integers(0, 3, n)})
    cfg = EffectConfig(n_splits=3)
    out = forest_nuisance(spark.createDataFrame(pdf), ["x"], cfg, [0, 1, 2]).toPandas()
    se = out.psi.std() / n ** 0.5
    assert abs(out.psi.mean() - 2.0) < 4 * se and np.corrcoef(out.e, 1 / (1 + np.exp(-out.x)))[0, 1] > 0.9


def test_arm_routes(spark):
    """Each route, a NULL group and a missing outcome."""
    rows = []
    for g, n, make in (("ok", 120, lambda i: float(i)), ("flat", 120, lambda i: 5.0), ("zeros", 200, lambda i: float(i == 4)),
                       ("short", 40, lambda i: float(i)), (None, 9, lambda i: float(i)), ("tiny", 0, None)):
        rows += [(g, 1, i % 2, make(i)) for i in range(n)] + [(g, 0, i % 2, float(i)) for i in range(100)]
    rows += [("ok", 1, 0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g string, t int, fold int, y double")
    status = arm_status(df, group=["g"])
    got = {(r.g, r.arm, r.fold): r for r in status.collect()}
    assert len(got) == 6 * 4
    assert {(g, r.route) for (g, arm, _), r in got.items() if arm == 1} == {
        ("ok", "model"), ("flat", "constant"), ("zeros", "constant"), ("short", "constant"), (None, "pooled"), ("tiny", "empty")}
    assert all(r.route == "model" for (_, arm, _), r in got.items() if arm == 0)
    nuis = df.select("*", F.lit(0.5).alias("e"), F.lit(111.0).alias("mu1"), F.lit(222.0).alias("mu0"), F.lit(333.0).alias("both"))
    out = route_arms(nuis, status, EffectConfig(n_splits=2), group=["g"], pooled="both").where("fold = 0").collect()
    mu1 = {r.g: r.mu1 for r in out}
    assert len(out) == len([r for r in rows if r[2] == 0])
    assert mu1["ok"] == 111 and mu1["flat"] == 5 and mu1["short"] == got["short", 1, 0].mean
    assert mu1[None] == 333 and mu1["tiny"] == 0 and {r.mu0 for r in out} == {222.0}
    mean = route_arms(nuis, status, EffectConfig(n_splits=2), ArmRules(empty="mean"), ["g"]).where("g = 'tiny' AND fold = 0").first()
    assert mean.mu1 == got["tiny", 1, 0].pooled_mean


def test_rows_of_one_part_are_spread_over_tasks(spark, monkeypatch):
    """A narrow table comes in few parts; its histograms are added up by all cores, with the same trees."""
    df, _ = frame(spark)
    cuts = [list(range(10)), [-1.0, -0.5, 0.0, 0.5, 1.0]]
    fam = [trees.Family("y", F.col("y"))]
    one = trees.grow(df.coalesce(1), ["a", "b"], fam, [0, 1, 2], depth=3, min_leaf=15, trees=3, cuts=cuts)
    parts, plain = [], trees._grow_levels
    monkeypatch.setattr(trees, "TASK_ROWS", (300, 1_000_000))
    monkeypatch.setattr(trees, "_grow_levels", lambda forest, rows, *a: (parts.append(rows.rdd.getNumPartitions()),
                                                                         plain(forest, rows, *a))[1])
    many = trees.grow(df.coalesce(1), ["a", "b"], fam, [0, 1, 2], depth=3, min_leaf=15, trees=3, cuts=cuts)
    assert parts[0] >= min(4, spark.sparkContext.defaultParallelism)
    assert (one.feature == many.feature).all() and (one.bin == many.bin).all() and np.allclose(one.value, many.value)


def test_bins_count_the_cut_points_below():
    x = np.array([[np.nan, -np.inf], [1.0, np.inf], [1.5, 0.0], [9.0, -0.0]])
    assert trees._bins(x, [np.array([1.0, 2.0]), np.array([0.0])]).tolist() == [[0, 1], [1, 2], [2, 1], [3, 1]]
