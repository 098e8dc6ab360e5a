"""Degenerate arms as data: which (fold, arm) is fitted, pooled or constant.

A learner that trains per fold and arm needs a rule for arms it can't learn
from.  :func:`arm_status` states per (group, fold, arm) what the training rows
(those of the other folds, with an outcome) hold — count, spread, share of
zeros — and the route that follows; :func:`route_arms` sends each row's outcome
predictions down that route.  Both are plans over folds × arms statistics, so
every learner (cells, linear, forests) shares one rule.

Routes, first that applies:

* ``empty``: no training row; the constant ``empty`` (0, or the mean of both arms);
* ``pooled``: fewer than ``pooled_below`` rows; the prediction of a model of both
  arms where the learner has one, else the mean of both arms;
* ``constant``: fewer than ``min_rows`` rows, a standard deviation under
  ``min_spread``, or a share of zeros of ``zero_share`` or more; the arm's mean;
* ``model``: the learner's own prediction.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.config import EffectConfig
from causeway.functions.scalar import aipw_psi
from causeway.operators.joins import join_small
from causeway.operators.nuisance.strata import _y_term, _y_value


# When an arm can't be learned from.
@dataclass(frozen=True)
class ArmRules:
    min_rows: int = 30
    min_spread: float = 1e-8
    zero_share: float = 0.98
    pooled_below: int = 10
    empty: str = "zero"             # or "mean"


def arm_status(panel: DataFrame, rules: ArmRules = ArmRules(), group: Sequence[str] = (), t: str = "t",
               y: str = "y", fold: str = "fold", y_scale: int | None = None) -> DataFrame:
    """``group…, fold, arm, n, mean, spread, zero_share, pooled_mean, route`` of
    the training rows of every fold and arm; one exchange, then windows over
    folds × arms rows.  Spread is the population standard deviation."""
    group = list(group)
    value = _y_term(F.col(y), y_scale)
    centre = F.lit(0) if y_scale is not None else F.lit(0.0)
    rows = panel.select(*group, fold, F.col(t).alias("arm"), value.alias("_y"))
    own = rows.groupBy(*group, fold, "arm").agg(
        F.count("_y").alias("_n"), F.coalesce(F.sum("_y"), centre).alias("_s"),
        F.coalesce(F.sum(F.col("_y").cast("double") * F.col("_y")), F.lit(0.0)).alias("_q"),
        F.count(F.when(F.col("_y") == 0, 1)).alias("_z"))
    # every fold meets both arms, those without a row too
    grid = (rows.select(*group, fold).distinct()
            .withColumn("arm", F.explode(F.array(F.lit(0), F.lit(1)))))
    keys = [*group, fold, "arm"]
    right = own.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n", "_s", "_q", "_z")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    full = grid.join(right, cond, "left").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("_n", "_s", "_q", "_z")])
    all_folds, arms = Window.partitionBy(*group, "arm"), Window.partitionBy(*group, fold)
    trained = full.select(*keys, *[(F.sum(c).over(all_folds) - F.col(c)).alias(c) for c in ("_n", "_s", "_q", "_z")])
    both = trained.select("*", F.sum("_n").over(arms).alias("_bn"), F.sum("_s").over(arms).alias("_bs"))
    n = F.col("_n")
    scale = 10.0 ** y_scale if y_scale is not None else 1.0
    mean = F.when(n > 0, _y_value(F.col("_s"), y_scale) / n)
    pooled = F.when(F.col("_bn") > 0, _y_value(F.col("_bs"), y_scale) / F.col("_bn"))
    variance = F.when(n > 0, F.greatest(F.col("_q") / n - (F.col("_s") / n) * (F.col("_s") / n), F.lit(0.0)))
    spread = F.sqrt(variance) / scale
    zeros = F.when(n > 0, F.col("_z") / n)
    flat = (n < rules.min_rows) | (spread < rules.min_spread) | (zeros >= rules.zero_share)
    return both.select(
        *keys, n.alias("n"), mean.alias("mean"), spread.alias("spread"), zeros.alias("zero_share"),
        pooled.alias("pooled_mean"),
        F.when(n == 0, "empty").when(n < rules.pooled_below, "pooled").when(flat, "constant").otherwise("model")
        .alias("route"))


def route_arms(nuis: DataFrame, status: DataFrame, cfg: EffectConfig, rules: ArmRules = ArmRules(),
               group: Sequence[str] = (), pooled: str | None = None, fold: str = "fold",
               max_groups: int | None = 1) -> DataFrame:
    """``mu1``, ``mu0`` by their routes (``route1``, ``route0``) and the ψ that
    follows.  ``pooled``: a column with the prediction of a model of both arms."""
    group = list(group)

    def side(arm: int) -> list[Column]:
        here = F.col("arm") == arm
        return [F.max(F.when(here, F.col("route"))).alias(f"route{arm}"), F.max(F.when(here, F.col("mean"))).alias(f"_mean{arm}")]

    wide = status.groupBy(*group, fold).agg(*side(1), *side(0), F.max("pooled_mean").alias("_pooled"))
    bound = None if max_groups is None or group else cfg.n_splits * max_groups
    out = join_small(nuis, wide, [*group, fold], "left", max_rows=bound)
    both = F.coalesce(F.col("_pooled"), F.lit(0.0))
    model = F.coalesce(F.col(pooled), both) if pooled else both
    for arm in (1, 0):
        route = F.col(f"route{arm}")
        out = out.withColumn(f"mu{arm}", F.when(route == "model", F.col(f"mu{arm}"))
                             .when(route == "constant", F.col(f"_mean{arm}"))
                             .when(route == "pooled", model)
                             .otherwise(both if rules.empty == "mean" else F.lit(0.0)))
    return out.drop("_mean1", "_mean0", "_pooled").withColumn("psi", aipw_psi("t", "y", "mu1", "mu0", "e"))
