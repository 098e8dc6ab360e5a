"""Spark ML nuisance learners (the counterpart of boosted-tree learners).

For each fold f a GBT classifier (t ~ x) and two GBT regressors (y ~ x per
arm) are fitted on the other folds and score fold f; each fit is a
distributed Spark ML job, k × 3 in total.  Degenerate arms follow the same
fallbacks as the cell learner: a constant target gives that constant, an
empty arm gives 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.config import EffectConfig
from causeway.functions.scalar import aipw_psi, propensity


def class_weights(df: DataFrame, scheme: bool | str = "balanced", t: str = "t") -> tuple[float, float]:
    """(treated, control) weights: ``balanced`` (or True) n / (2 n_arm), ``sqrt``
    the root of largest arm / n_arm, else 1; an empty arm counts as one row."""
    if not scheme:
        return 1.0, 1.0
    n1, n = df.agg(F.sum(t), F.count(t)).first()
    arms = max(n1 or 0, 1), max(n - (n1 or 0), 1)
    if scheme == "sqrt":
        return (max(arms) / arms[0]) ** 0.5, (max(arms) / arms[1]) ** 0.5
    if scheme not in (True, "balanced"):
        raise ValueError(f"unknown class weights: {scheme}")
    return n / (2.0 * arms[0]), n / (2.0 * arms[1])


def ml_nuisance(panel: DataFrame, xcols: Sequence[str], cfg: EffectConfig, folds: Sequence[int],
                fold: str = "fold", max_iter: int = 20, max_depth: int = 4, step: float = 0.1,
                balanced: bool | str = True, outcome_loss: str = "squared",
                tweedie_power: float = 1.3) -> DataFrame:
    """``outcome_loss='tweedie'`` fits the arm outcome models as Tweedie GLMs
    (log link, variance power in [1.1, 1.9]) instead of squared-loss GBTs."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import GBTRegressor

    asm = VectorAssembler(inputCols=list(xcols), outputCol="_x", handleInvalid="keep")
    data = asm.transform(panel.fillna(0.0, subset=list(xcols)))
    w1, w0 = class_weights(data, balanced)
    data = data.withColumn("_w", F.when(F.col("t") == 1, w1).otherwise(w0))
    parts = None
    for f in sorted(folds):
        train = data.where(F.col(fold) != f)
        test = data.where(F.col(fold) == f)
        clf = GBTClassifier(featuresCol="_x", labelCol="t", weightCol="_w", maxIter=max_iter,
                            maxDepth=max_depth, stepSize=step, seed=cfg.seed + f)
        scored = clf.fit(train.withColumn("t", F.col("t").cast("double"))).transform(test) \
            .withColumn("e_raw", vector_to_array("probability")[1]) \
            .drop("probability", "rawPrediction", "prediction")
        for arm in (1, 0):
            tr = train.where((F.col("t") == arm) & F.col("y").isNotNull())
            st = tr.agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"),
                        F.avg("y").alias("m")).first()
            col = f"mu{arm}"
            if not st["n"]:
                scored = scored.withColumn(col, F.lit(0.0))
            elif st["hi"] - st["lo"] < 1e-12 or st["n"] < 10:
                scored = scored.withColumn(col, F.lit(float(st["m"])))
            elif outcome_loss == "tweedie":
                from pyspark.ml.regression import GeneralizedLinearRegression

                if st["lo"] < 0:
                    raise ValueError("a Tweedie outcome can't be negative: use the squared loss")
                glm = GeneralizedLinearRegression(featuresCol="_x", labelCol="y", family="tweedie",
                                                  variancePower=min(max(tweedie_power, 1.1), 1.9),
                                                  linkPower=0.0, maxIter=25, regParam=1e-6,
                                                  predictionCol=col)
                scored = glm.fit(tr).transform(scored)
            else:
                reg = GBTRegressor(featuresCol="_x", labelCol="y", maxIter=max_iter, maxDepth=max_depth,
                                   stepSize=step, seed=cfg.seed + 10 * f + arm, predictionCol=col)
                scored = reg.fit(tr).transform(scored)
        parts = scored if parts is None else parts.unionByName(scored)
    out = parts.drop("_x", "_w").withColumn("e", propensity("e_raw", cfg.trim, cfg.ps_clip))
    return out.withColumn("psi", aipw_psi("t", "y", "mu1", "mu0", "e"))
