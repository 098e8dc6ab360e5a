"""Supervised column scores, PCA add-on, anchor-selected PCA cap, tree-leaf
embedding — reductions fitted with Spark ML on all rows (no sampling).

* ``column_scores``: α·|corr| + (1 − α)·std per column in one aggregate,
  where corr is the covariance with population normalisation over the
  sample standard deviations (so it is Pearson's r scaled by (n − 1)/n),
  and std has ddof 1; with no target the score is the std alone.
* ``pca_features``: StandardScaler (centred) + PCA → ``pca_i``.
* ``pca_cap``: if there are more numeric columns than ``cap``, keep the top
  max(20, ceil(0.2·p)) by score as anchors, scale, PCA to min(cap, anchors)
  and replace all numeric columns by ``dsban_pc_i``.
* ``leaf_embedding``: a GBT fitted on (features, target) gives one leaf index
  per tree (``leaf_idx_i``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.config import EPS
from causeway.operators.joins import keep as keep_table

ALPHA = 0.7
MIN_ANCHORS = 20
ANCHOR_FRAC = 0.2


def column_scores(df: DataFrame, cols: Sequence[str], y: str | None = None,
                  alpha: float = ALPHA) -> DataFrame:
    """``feature, corr, std, score`` for every column, one aggregate pass."""
    aggs = []
    for c in cols:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        aggs.append(F.stddev_samp(x).alias(f"{c}__sd"))
        if y is not None:
            aggs.append(F.covar_pop(x, F.col(y).cast("double")).alias(f"{c}__cov"))
    if y is not None:
        aggs.append(F.stddev_samp(F.col(y).cast("double")).alias("__ysd"))
    wide = df.agg(*aggs)
    rows = []
    for c in cols:
        sd = F.col(f"{c}__sd") + EPS
        if y is not None:
            corr = F.coalesce(F.col(f"{c}__cov") / ((F.col("__ysd") + EPS) * sd), F.lit(0.0))
            score = alpha * F.abs(corr) + (1 - alpha) * sd
        else:
            corr = F.lit(None).cast("double")
            score = F.col(f"{c}__sd")
        rows.append(F.struct(F.lit(c).alias("feature"), corr.alias("corr"),
                             F.col(f"{c}__sd").alias("std"), score.alias("score")))
    return wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def _assemble(df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    filled = df.fillna(0.0, subset=list(cols))
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(filled)


def pca_fit(df: DataFrame, cols: Sequence[str], k: int, scale: bool = True, prefix: str = "pca_") -> dict:
    """Fitted scaler and components over ``cols`` (NULL counts as 0)."""
    from pyspark.ml.feature import PCA, StandardScaler

    data, scaler = _assemble(df, cols, "_x").select("_x"), None
    if scale:
        scaler = StandardScaler(inputCol="_x", outputCol="_xs", withMean=True, withStd=True).fit(data)
        data = scaler.transform(data)
    k = min(k, len(cols))
    model = PCA(k=k, inputCol="_xs" if scale else "_x", outputCol="_pc").fit(data)
    return {"cols": list(cols), "k": k, "scaler": scaler, "pca": model, "prefix": prefix}


def pca_apply(df: DataFrame, fitted: dict) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    data = _assemble(df, fitted["cols"], "_x")
    if fitted["scaler"] is not None:
        data = fitted["scaler"].transform(data)
    out = fitted["pca"].transform(data).withColumn("_pca", vector_to_array("_pc"))
    return out.select(*df.columns, *[F.col("_pca")[i].alias(f"{fitted['prefix']}{i + 1}") for i in range(fitted["k"])])


def pca_features(df: DataFrame, cols: Sequence[str], k: int, scale: bool = True,
                 prefix: str = "pca_") -> DataFrame:
    return pca_apply(df, pca_fit(df, cols, k, scale, prefix))


def anchors_of(df: DataFrame, cols: Sequence[str], y: str | None = None) -> list[str]:
    """The top max(20, ceil(0.2 p)) columns by score."""
    scores = column_scores(df, cols, y).orderBy(F.col("score").desc(), F.col("feature")).collect()
    return [r["feature"] for r in scores[:min(len(cols), max(MIN_ANCHORS, math.ceil(ANCHOR_FRAC * len(cols))))]]


def pca_cap(df: DataFrame, cols: Sequence[str], cap: int, y: str | None = None,
            keep: Sequence[str] = ("id",)) -> tuple[DataFrame, list[str]]:
    """Replace the numeric columns by ``min(cap, anchors)`` anchor PCs when
    there are more than ``cap`` of them; returns (frame, anchors)."""
    if len(cols) <= cap:
        return df, list(cols)
    df = keep_table(df)     # read for the scores, the scaler, the components and the result
    anchors = anchors_of(df, cols, y)
    out = pca_features(df.select(*keep, *anchors), anchors, min(cap, len(anchors)), True, "dsban_pc_")
    return out.drop(*anchors), anchors


def leaf_fit(df: DataFrame, cols: Sequence[str], y: str, task: str = "reg",
             trees: int = 20, depth: int = 4, seed: int = 42) -> dict:
    """GBT of ``y`` on ``cols``, fitted on the rows that have a target."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    est = (GBTClassifier if task == "clf" else GBTRegressor)(
        featuresCol="_x", labelCol=y, maxIter=trees, maxDepth=depth, seed=seed, leafCol="_leaf")
    return {"cols": list(cols), "trees": trees,
            "model": est.fit(_assemble(df, cols, "_x").where(F.col(y).isNotNull()))}


def leaf_apply(df: DataFrame, fitted: dict) -> DataFrame:
    """``leaf_idx_i`` — the leaf reached in each tree of a fitted GBT."""
    from pyspark.ml.functions import vector_to_array

    out = fitted["model"].transform(_assemble(df, fitted["cols"], "_x")).withColumn("_l", vector_to_array("_leaf"))
    return out.select(*df.columns, *[F.col("_l")[i].cast("int").alias(f"leaf_idx_{i}")
                                     for i in range(fitted["trees"])])


def leaf_embedding(df: DataFrame, cols: Sequence[str], y: str, task: str = "reg",
                   trees: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    return leaf_apply(df, leaf_fit(df, cols, y, task, trees, depth, seed))
