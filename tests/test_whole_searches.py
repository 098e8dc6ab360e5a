"""Searches try all of their candidates, however good an early one is."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row

from causeway.operators import distill, tune
from causeway.plans import catalog


def test_student_search_scores_every_leaf_share(spark):
    """The teacher is a step of x, so the first share already scores above 0.75."""
    rng = np.random.default_rng(8)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "fold": np.arange(n) % 2, "x": rng.uniform(size=n)})
    pdf["tau"] = np.where(pdf.x > 0.5, 4.0, -2.0) + np.where(pdf.x > 0.8, 3.0, 0.0)
    pdf["psi"] = pdf.tau
    _, table = distill.student_tree(spark.createDataFrame(pdf), ["x"], depths=(2, 3), leaf_shares=(0.05, 0.1, 0.3))
    rows = table.collect()
    assert sorted((r.depth, r.leaf_share) for r in rows) == [(d, s) for d in (2, 3) for s in (0.05, 0.1, 0.3)]
    assert max(r.score for r in rows if r.leaf_share == 0.05) >= 0.75
    best = [r for r in rows if r.best]
    assert len(best) == 1 and best[0].score == max(r.score for r in rows)


@pytest.mark.parametrize("name, objective", [
    ("tune_nauuc_plain", "nauuc"), ("tune_nauuc", "nauuc_ci"), ("tune_fused", "fused"), ("tune_min_var", "min_var"),
    ("tune_band", "band"), ("tune_light", "light")])
def test_tuner_queries_make_all_trials(spark, monkeypatch, name, objective):
    """30 trials, though all of them score above 0.5; those after the random ones come from the proposals."""
    asked = []

    def evaluated(tau, objective, band, k):
        asked.append(objective)
        row = Row(nauuc=0.9, ci_width_norm=0.1, fold_variance=1.0, band_coverage=1.0, n_band=300, band_nauuc=0.9,
                  objective=0.6 + 0.01 * (len(asked) * 7 % 30))
        return SimpleNamespace(first=lambda: row)

    panel = spark.createDataFrame([(1, 0)], "id long, fold int")
    monkeypatch.setattr(catalog, "customer_folds", lambda *a: panel)
    monkeypatch.setattr(tune, "evaluate", evaluated)
    monkeypatch.setattr(tune.tune, "__defaults__", tuple(
        (lambda panel, *a, **kw: panel) if d is tune.trial_scores else d for d in tune.tune.__defaults__))
    rows = sorted(catalog.QUERIES[name](spark, "").collect(), key=lambda r: r.trial)
    assert [r.trial for r in rows] == list(range(30)) and asked == [objective] * 30
    done = [r.asDict() for r in rows]
    names = [d.name for d in tune.SPACE]
    for i in range(30):
        assert tune.propose(done[:i], 42) == {c: done[i][c] for c in names}
    assert [r.trial for r in rows if r.best] == [max(done, key=lambda t: (t["objective"], -t["trial"]))["trial"]]
