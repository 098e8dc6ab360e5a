"""The bucketed global order equals a plain window, ties and NULLs included."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from causeway.operators import order
from causeway.operators.joins import join_null_safe
from causeway.operators.order import exact_quantiles, ordered


def _frame(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    score = rng.normal(size=n)
    score[: n // 3] = 0.25                     # a third of the rows share one value
    score[n // 3: n // 3 + 50] = np.nan        # missing scores sort last
    pdf = pd.DataFrame({"id": rng.permutation(n).astype("int64"), "score": score,
                        "g": rng.integers(0, 3, n).astype("int32"), "v": rng.normal(size=n)})
    df = spark.createDataFrame(pdf).withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    return df, pdf


def test_bucketed_equals_window(spark):
    df, pdf = _frame(spark)
    df = (df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))
          .withColumn("name", F.concat(F.lit("user-"), F.lpad(F.col("id").cast("string"), 7, "0"))))
    for asc in (True, False):
        for tie in ("id", "name"):
            for rows in (400, 9):
                got = ordered(df, "score", asc, tie, ["g"], sums=["v"], bucket_rows=rows).toPandas()
                assert len(got) == len(pdf)
                key = got.score if asc else -got.score
                want = got.assign(key=key).sort_values(["key", tie], na_position="last")
                for _, part in want.groupby("g", dropna=False):
                    assert list(part.pos) == list(range(1, len(part) + 1))
                    assert np.allclose(part.cum_v, part.v.cumsum())


def test_hot_value_is_spread_over_buckets(spark):
    """A value that a third of all rows share is split by the tie-break, ids that are strings too."""
    df = (spark.range(30_000).withColumn("score", F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") * 1.0))
          .withColumn("name", F.concat(F.substring("id", -1, 1), F.lit("-"), F.lpad(F.col("id").cast("string"), 9, "0"))))
    for tie in ("id", "name"):
        got = ordered(df, "score", tie=tie, bucket_rows=600)
        assert [r.pos for r in got.orderBy("score", tie).collect()] == list(range(1, 30_001))
        sizes = _bucket_sizes(df, tie, [], 600)
        assert len(sizes) >= 40 and max(sizes.values()) < 2_500


def _bucket_sizes(df, tie, group, rows):
    """Rows per (group, bucket), from the operator's own splitters."""
    row = F.struct(F.col("score").isNull().alias("m"), F.coalesce("score", F.lit(0.0)).alias("k"), F.col(tie).alias("t"))
    cuts = order.splitters(df, row, tie, group, rows)
    j = join_null_safe(df, cuts, group) if group else df.crossJoin(cuts)
    counted = j.withColumn("b", order._bucket(F.col("_cuts"), row)).groupBy(*group, "b").count().collect()
    return {tuple(r[:-1]): r["count"] for r in counted}


def test_a_narrow_group_has_cut_points_of_its_own(spark):
    """Scores of one campaign lie in a sliver of the others' range; NULL is a campaign."""
    df = spark.range(24_000).select(
        "id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 3 == 1, 0.5 + F.col("id") * 1e-12).otherwise(F.hash("id") * 1.0).alias("score"))
    sizes = _bucket_sizes(df, "id", ["g"], 400)
    for g in (None, 1, 2):
        mine = [n for (k, _), n in sizes.items() if k == g]
        assert sum(mine) == 8_000 and len(mine) >= 15 and max(mine) < 1_600
    got = ordered(df, "score", False, "id", ["g"], bucket_rows=400).toPandas()
    for _, part in got.groupby("g", dropna=False):
        assert list(part.sort_values(["score", "id"], ascending=[False, True]).pos) == list(range(1, 8_001))


def test_all_null_keys_and_null_ties(spark):
    df = spark.range(5_000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.lit(None).cast("double").alias("score"))
    got = ordered(df, "score", bucket_rows=100).orderBy("id").collect()
    assert [r.pos for r in got] == list(range(1, 5_001))


def test_positions_are_a_permutation(spark):
    df, pdf = _frame(spark, seed=2)
    a = ordered(df, "score", False, "id", bucket_rows=190).toPandas()
    assert sorted(a.pos) == list(range(1, len(pdf) + 1))
    s = pdf.assign(key=-pdf.score).sort_values(["key", "id"], na_position="last")
    assert list(a.set_index("id").loc[s.id, "pos"]) == list(range(1, len(pdf) + 1))


def test_exact_quantiles_match_numpy(spark):
    df, pdf = _frame(spark, seed=3)
    probs = [0.01, 0.1, 0.5, 0.9, 0.99]
    q = exact_quantiles(df, "v", probs, ["g"]).toPandas()
    for g, part in pdf.groupby("g"):
        want = np.quantile(part.v, probs)
        got = q[q.g == g].sort_values("p").q.to_numpy()
        assert np.allclose(want, got)


def test_buckets_are_sorted_in_many_tasks(spark):
    """Few bytes, many buckets: the sort is not left to one task, and no row is sent to a task by its group alone."""
    df, _ = _frame(spark)
    out = ordered(df, "score", group=["g"], bucket_rows=100)
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
