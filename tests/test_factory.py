"""The feature factory applies what it learned to another batch."""

import pytest
from pyspark.sql import functions as F

from causeway.operators.features.factory import FeatureFactory


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(i, i % 5, ["a", "b", "c", None][i % 4], float(i % 17), float((i * 7) % 23), i % 3,
             float((i % 4 == 0) != (i % 7 == 0))) for i in range(400)]
    return spark.createDataFrame(rows, "id long, fold int, seg string, x1 double, x2 double, n int, y double").persist()


def factory(**kw):
    return FeatureFactory(cat_cols=["seg"], num_cols=["x1", "x2", "n"], group_keys=[["seg"]], woe=True, **kw)


@pytest.mark.parametrize("kw", [{}, {"leaf_embeddings": True, "pca": 3}, {"max_total_cols": 12}])
def test_transform_has_the_columns_of_the_fit(panel, kw):
    ff = factory(**kw)
    fit = ff.fit_transform(panel, "y")
    again = ff.transform(panel.drop("fold"))
    assert ff.feature_columns(again, panel) == ff.feature_columns(fit, panel)
    if "max_total_cols" in kw:
        assert len(ff.feature_columns(again, panel)) == 12
    else:  # all but the out-of-fold encodings are the same on the training rows
        same = [c for c in ff.feature_columns(fit, panel) if not c.endswith("__te") and not c.startswith("pca_")]
        cols = [F.round(F.col(c).cast("double"), 9) for c in ["id", *same]]
        assert sorted(map(str, fit.select(*cols).collect())) == sorted(map(str, again.select(*cols).collect()))
    ff.release()


def test_one_row_batch_and_unseen_level(spark, panel):
    ff = factory(quantile_bins=0, poly2=False)
    ff.fit_transform(panel, "y")
    batch = spark.createDataFrame([(1, "a", 1.0, 2.0, 1), (2, "new", 1.0, 2.0, 1)],
                                  "id long, seg string, x1 double, x2 double, n int")
    one, new = ff.transform(batch).orderBy("id").collect()
    assert (one.seg__count, one.seg__freq, one.grp_seg__x1__count) == (100.0, 0.25, 100.0)
    assert one.seg__woe is not None
    mean = panel.agg(F.avg("y")).first()[0]
    assert new.seg__te == pytest.approx(mean) and new.seg__count == 0.0
    assert new.seg__woe is None and new.grp_seg__x1__mean is None
    ff.state = "batch"
    assert ff.transform(batch.where("id = 1")).first().seg__count == 1.0


def test_transform_needs_a_fit(panel):
    with pytest.raises(ValueError):
        factory().transform(panel)
