"""Saved feature models, symbolic search, Parzen proposals and resumable tuning."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from causeway.config import EffectConfig
from causeway.operators import tune
from causeway.operators.features import symbolic
from causeway.operators.features.factory import FeatureFactory
from causeway.operators.features.saved import FeatureEstimator, FeatureModel, fit_and_save


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(i, i % 5, ["a", "b", "c", None][i % 4], float(i % 17), float((i * 7) % 23), i % 3,
             float((i % 4 == 0) != (i % 7 == 0))) for i in range(300)]
    return spark.createDataFrame(rows, "id long, fold int, seg string, x1 double, x2 double, n int, y double").persist()


# ------------------------------------------------------------ saved models
@pytest.mark.parametrize("kw", [{}, {"leaf_embeddings": True, "pca": 3}, {"max_total_cols": 12}])
def test_a_saved_model_transforms_as_the_fitted_one(spark, panel, tmp_path, kw):
    ff = FeatureFactory(cat_cols=["seg"], num_cols=["x1", "x2", "n"], group_keys=[["seg"], ["seg", "n"]], woe=True, **kw)
    model = fit_and_save(ff, panel, f"{tmp_path}/m", "y")
    batch = panel.drop("fold", "y").limit(50).unionByName(spark.createDataFrame([(999, "new", 1.0, None, 1)],
                                                          "id long, seg string, x1 double, x2 double, n int"))
    want = model.transform(batch)
    loaded = FeatureModel.load(f"{tmp_path}/m")
    other = spark.newSession()      # nothing of the fit is left there
    again = FeatureModel.load(f"{tmp_path}/m")
    assert other is not spark and loaded.factory.fitted.keys() == model.factory.fitted.keys()
    got = again.transform(batch)
    assert got.columns == want.columns
    rounded = lambda d: sorted(str([None if v is None else round(v, 8) if isinstance(v, float) else v for v in r])
                               for r in d.collect())
    assert rounded(got) == rounded(want)
    with pytest.raises(Exception):
        model.write().save(f"{tmp_path}/m")       # a folder is only replaced if told so
    model.write().overwrite().save(f"{tmp_path}/m")


def test_the_step_goes_into_a_pipeline(panel):
    ff = FeatureFactory(cat_cols=["seg"], num_cols=["x1"], quantile_bins=0, poly2=False)
    out = Pipeline(stages=[FeatureEstimator(ff, "y")]).fit(panel).transform(panel)
    assert {"seg__te", "seg__count", "x1__log1p"} <= set(out.columns) and ff.fitted == {}


# ------------------------------------------------------------ symbolic search
def test_canonical_forms():
    a, b = ("col", "a"), ("col", "b")
    c = symbolic.canonical
    assert c("+", b, a) == c("+", a, b) and c("*", a, a) == ("square", a) and c("-", a, a) is None and c("/", a, a) is None
    assert c("-", a, b) != c("-", b, a) and c("abs", ("square", a)) is None
    forms = [symbolic.text(e) for e in symbolic.grown([a, b], [a, b])]
    assert len(forms) == len(set(forms)) and "(b + a)" not in forms


@pytest.mark.parametrize("planted", ["(a * b)", "(a / c)", "((a * b) / c)"])
def test_planted_expressions_are_found(spark, planted):
    rng = np.random.default_rng(4)
    n = 3000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.normal(size=n) + 0.3, "c": rng.uniform(0.5, 3, n), "d": rng.normal(size=n)})
    pdf["y"] = eval(planted, {}, {k: pdf[k] for k in "abcd"}) + rng.normal(size=n) * 0.2
    df = spark.createDataFrame(pdf)
    best, table = symbolic.symbolic_search(df, list("abcd"), "y")
    names = [symbolic.text(e) for e in best[:3]]
    assert planted in names, names
    per = table.groupBy("expression").count().agg(F.max("count")).first()[0]
    assert per == 1                                # no form is scored twice
    out = symbolic.symbolic_features(df, best[:2])
    assert {"sym_0", "sym_1"} <= set(out.columns)
    top = table.where(F.col("expression") == symbolic.text(best[0])).first()
    assert abs(out.select(F.corr("sym_0", "y")).first()[0] - top["corr"]) < 1e-9


def test_undefined_values_and_constants(spark):
    df = spark.createDataFrame([(float(i % 2), 5.0, None if i % 4 else 1.0, float(i)) for i in range(40)],
                               "a double, k double, gone double, y double")
    rows = {r.expression: r for r in symbolic.scored(df, [("col", "k"), ("col", "gone"), ("/", ("col", "y"), ("col", "a"))], "y").collect()}
    assert rows["k"].corr is None and rows["gone"].corr is None and rows["(y / a)"].n == 20
    assert symbolic.scored(df.limit(0), [("col", "k")], "y").count() == 0


# ------------------------------------------------------------ proposals
def test_proposals_follow_seed_and_trials_only():
    trials = []
    for i in range(20):
        p = tune.propose(trials, 7)
        assert p == tune.propose(list(trials), 7)
        assert 2 <= p["depth"] <= 6 and 5 <= p["min_leaf"] <= 80 and p["calibration"] in ("none", "sigmoid")
        trials.append({"trial": i, **p, "objective": -abs(p["depth"] - 5) - abs(np.log(p["trim"] / 0.01))})
    assert tune.propose([], 7) != tune.propose([], 8)


def test_proposals_beat_random_draws():
    """On a smooth objective the later half of the trials is better than random ones."""
    def value(p):
        return -((p["feature_share"] - 0.8) / 0.7) ** 2 - (np.log(p["trim"] / 0.02)) ** 2 / 16 - (p["calibration"] == "none") * 0.3

    later, random = [], []
    for seed in range(12):
        trials = []
        for i in range(30):
            p = tune.propose(trials, seed)
            trials.append({"trial": i, **p, "objective": value(p)})
        later += [t["objective"] for t in trials[15:]]
        rng = np.random.RandomState(seed)
        random += [value({d.name: d.choices[rng.randint(len(d.choices))] if d.choices else d.value(rng.uniform()) for d in tune.SPACE})
                   for _ in range(15)]
    assert np.mean(later) > np.mean(random) + 0.15


def scores_of(tau):
    return lambda panel, xcols, cfg, folds, params, fused=False, seed=0: tau.withColumn(
        "tau", F.col("tau") + F.lit(float(params["feature_share"])) * F.hash("id") % 5)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "fold": np.arange(n) % 3, "e": np.where(np.arange(n) % 5 == 0, 0.5, 0.95),
                        "y": rng.normal(size=n), "tau": rng.normal(size=n), "t": np.arange(n) // 5 % 2})
    pdf["psi"] = pdf.tau + rng.normal(size=n)
    return spark.createDataFrame(pdf).persist()


def test_a_stopped_search_goes_on_where_it_was(spark, table, tmp_path):
    args = (table, [], EffectConfig(n_splits=3), [0, 1, 2], "nauuc")
    kw = {"stop": None, "scores": scores_of(table), "seed": 3}
    whole = tune.tune(*args, trials=8, **kw).drop("best").collect()
    tune.tune(*args, trials=3, path=f"{tmp_path}/s", **kw)
    assert len(tune.read_trials(spark, f"{tmp_path}/s")) == 3
    resumed = tune.tune(*args, trials=8, path=f"{tmp_path}/s", **kw)
    assert resumed.drop("best").collect() == whole and resumed.where("best").count() == 1
    assert set(tune.best_params(resumed)) == {d.name for d in tune.SPACE}
    early = tune.tune(*args, trials=8, **{**kw, "stop": -10.0}).collect()
    assert len(early) == 1


def test_objectives_and_penalties(spark, table):
    get = lambda o, d=table, band=(0.2, 0.8): tune.evaluate(d, o, band, 3).first()
    plain = get("nauuc")
    assert plain.objective == plain.nauuc and plain.n_band == 80 and plain.band_coverage == 0.2
    assert np.isclose(get("nauuc_ci").objective, plain.nauuc - 0.15 * plain.ci_width_norm)
    assert np.isclose(get("fused").objective, plain.nauuc - 0.1 * plain.ci_width_norm)
    assert np.isclose(get("min_var").objective, -plain.fold_variance)
    band = get("band")
    assert np.isclose(band.objective, band.band_nauuc * 0.6 * 0.85)       # few rows and low coverage
    # the light rule: fewer than 100 rows in the band, so the base band's; coverage under 25 % costs a tenth
    light = get("light")
    assert light.n_band == 80 and np.isclose(light.objective, 0.9 * light.band_nauuc)
    wide = get("light", table.withColumn("e", F.lit(0.5)))
    assert wide.band_coverage == 1 and wide.objective == wide.band_nauuc
    with pytest.raises(ValueError):
        get("other")


def test_a_trial_runs_through(spark):
    rng = np.random.default_rng(6)
    n = 300
    pdf = pd.DataFrame({"id": np.arange(n), "fold": np.arange(n) % 3, "x": rng.normal(size=n), "t": rng.integers(0, 2, n)})
    pdf["y"] = pdf.x * pdf.t + rng.normal(size=n)
    params = {"depth": 2, "min_leaf": 10, "trees": 4, "feature_share": 0.5, "trim": 0.01, "calibration": "sigmoid"}
    out = tune.trial_scores(spark.createDataFrame(pdf), ["x"], EffectConfig(n_splits=3), [0, 1, 2], params, fused=True)
    assert out.where("tau IS NULL OR psi IS NULL").count() == 0 and out.count() == n
