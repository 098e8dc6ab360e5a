"""The campaign plans: diagnosis by group, the learned campaign, calibration, report text."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.config import EffectConfig
from causeway.operators import hte
from causeway.operators.nuisance.calibrate import calibrate
from causeway.plans import campaign as camp
from causeway.plans.report import report_table
from causeway.sources.panels import customer_cell, panel_customer
from conftest import SF01


def planted(spark, n=1500, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    t = (rng.random(n) < 1 / (1 + np.exp(-x))).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "t": t, "x": x, "z": rng.normal(size=n), "seg": rng.choice(["a", "b"], n)})
    pdf["y"] = 3 * x + t * (2.0 + 2.0 * (pdf.z > 0)) + rng.normal(size=n)
    return spark.createDataFrame(pdf)


def test_diagnosis_of_each_activity_and_its_text(spark):
    """Per group as alone, a NULL activity included; a tiny activity gets a note, no ranking."""
    panel = panel_customer(spark, SF01).withColumn("activity_id", F.when(F.col("region") > 1, F.col("seg")))
    tiny = panel.where("region = 0").limit(20).withColumn("activity_id", F.lit("tiny"))
    both = panel.where("activity_id IS NULL OR activity_id = 'BUILDING'").unionByName(tiny)
    parts = camp.campaign_parts(both, customer_cell())
    d = camp.campaign_diagnosis(parts, ["before_cnt", "acctbal"])
    got = {r.activity_id: r for r in d.collect()}
    assert set(got) == {None, "BUILDING", "tiny"}
    one = camp.campaign_parts(both.where("activity_id = 'BUILDING'"), customer_cell())
    alone = camp.campaign_diagnosis(one, ["before_cnt", "acctbal"]).first()
    for c in ("n", "ovl", "ks", "smd_max", "placebo_p", "verdict", "nauuc", "policy_10"):
        a, b = got["BUILDING"][c], alone[c]
        assert a == b or abs(a - b) < 1e-6 * max(1, abs(b)), c
    assert got["tiny"].nauuc is None and got["tiny"].policy_10 is None and "band" in got["tiny"].note
    text = {r.activity_id: r.report for r in report_table(parts.ate, d, camp.CAMPAIGN_CFG.rules).collect()}
    assert set(text) == set(got) and text["BUILDING"].endswith(f"- verdict: {got['BUILDING'].verdict}")
    assert "n/a" in text["tiny"] and "band too small" in text["tiny"]


def test_effects_are_learned_in_the_band_and_given_to_all(spark):
    df = spark.createDataFrame([(i, i % 2, "s", 0.5 if i % 4 < 2 else 0.99, 1.0 if i % 4 < 2 else 100.0) for i in range(80)],
                               "id long, fold int, seg string, e double, psi double")
    inside = hte.dr_segment(df, "seg", train=F.col("e").between(0.2, 0.8))
    assert {r.tau for r in inside.collect()} == {1.0} and inside.count() == 80
    assert {r.tau for r in hte.dr_segment(df, "seg").collect()} == {50.5}


def test_learned_campaign_finds_the_effect(spark):
    spec = camp.CampaignSpec(activity_id="spring", att_band=(0.1, 0.9), hte_band=(0.1, 0.9))
    res, tau = camp.full_campaign(planted(spark), None, ["x", "z", "absent"], [["seg"]], spec, trials=1, trees=20)
    row = res.first()
    assert row.activity_id == "spring" and row.n == 1500 and row.n_features > 5
    assert abs(row.ate_est - 3.0) < 4 * row.ate_se and abs(row.att_est - 3.0) < 4 * row.att_se
    by = tau.join(planted(spark).select("id", "z"), "id").groupBy((F.col("z") > 0).alias("up")).agg(F.avg("tau").alias("m")).collect()
    m = {r.up: r.m for r in by}
    assert m[True] - m[False] > 0.5 and row.nauuc > 0.1


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibration_mends_a_distorted_propensity(spark, method):
    rng = np.random.default_rng(4)
    n = 4000
    true = rng.uniform(0.1, 0.9, n)
    z = np.log(true / (1 - true))
    pdf = pd.DataFrame({"id": np.arange(n), "fold": rng.integers(0, 3, n), "t": (rng.random(n) < true).astype(int), "y": rng.normal(size=n),
                        "mu1": 0.0, "mu0": 0.0, "true": true, "e": 1 / (1 + np.exp(-(0.4 * z + 0.8)))})
    out = calibrate(spark.createDataFrame(pdf), EffectConfig(n_splits=3), [0, 1, 2], method).toPandas()
    assert len(out) == n and np.abs(out.e - out.true).mean() < 0.25 * np.abs(pdf.e - pdf.true).mean()
    with pytest.raises(ValueError):
        calibrate(spark.createDataFrame(pdf), EffectConfig(), [0], "other")
