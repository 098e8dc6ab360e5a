"""Propensity calibration on out-of-fold scores.

``sigmoid``: Platt scaling — a logistic regression of t on logit(ê) over the
other folds' rows; the iterations of all folds advance in the same aggregates.
``isotonic``: Spark ML isotonic regression (pool-adjacent-violators) of t on ê,
cross-fitted the same way, a fit per fold.  The result replaces ``e_raw`` and
keeps ``e`` clipped as configured.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.config import EffectConfig
from causeway.functions.scalar import aipw_psi, propensity
from causeway.operators.nuisance.linear import logit_oof


def calibrate(nuis: DataFrame, cfg: EffectConfig, folds: Sequence[int], method: str = "isotonic",
              fold: str = "fold") -> DataFrame:
    if method == "sigmoid":
        data = nuis.withColumn("_z", F.log(F.col("e") / (1 - F.col("e"))))
        betas = logit_oof(data, ["_z"], folds, fold)
        line = F.lit(None).cast("double")
        for f, b in betas.items():
            line = F.when(F.col(fold) == f, F.lit(float(b[0])) + F.lit(float(b[1])) * F.col("_z")).otherwise(line)
        out = data.withColumn("e_raw", 1.0 / (1.0 + F.exp(-line))).drop("_z")
    elif method == "isotonic":
        out = _isotonic(nuis, folds, fold)
    else:
        raise ValueError(f"unknown calibration: {method}")
    out = out.withColumn("e", propensity("e_raw", cfg.trim, cfg.ps_clip))
    return out.withColumn("psi", aipw_psi("t", "y", "mu1", "mu0", "e"))


def _isotonic(nuis: DataFrame, folds: Sequence[int], fold: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    data = VectorAssembler(inputCols=["e"], outputCol="_zv").transform(nuis).withColumn("_t", F.col("t").cast("double"))
    parts = None
    for f in sorted(folds):
        model = IsotonicRegression(featuresCol="_zv", labelCol="_t", predictionCol="_cal").fit(data.where(F.col(fold) != f))
        p = model.transform(data.where(F.col(fold) == f))
        parts = p if parts is None else parts.unionByName(p)
    return parts.drop("_zv", "_t").withColumn("e_raw", F.col("_cal")).drop("_cal")
