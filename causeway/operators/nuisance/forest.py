"""Forest nuisances: propensity, both arms and the pooled outcome of every fold
in one growth (see operators/trees.py), degenerate arms routed by the shared
rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.config import EffectConfig
from causeway.functions.scalar import aipw_psi, propensity
from causeway.operators.nuisance.arms import ArmRules, arm_status, route_arms
from causeway.operators.trees import Family, grow, predict


def forest_nuisance(panel: DataFrame, xcols: Sequence[str], cfg: EffectConfig, folds: Sequence[int],
                    fold: str = "fold", trees: int = 20, depth: int = 5, bins: int = 32, min_leaf: int = 10,
                    mtry: int | None = None, rules: ArmRules | None = ArmRules()) -> DataFrame:
    """Row-level e_raw, e, mu1, mu0, psi.  ``depth`` passes over the panel, whatever
    the number of folds, arms and trees, and one to score."""
    y = F.col("y").cast("double")
    families = [Family("e_raw", F.col("t"))] + [Family(f"mu{a}", y, F.col("t") == a) for a in (1, 0)] + [Family("mu_all", y)]
    forest = grow(panel, xcols, families, folds, fold, depth=depth, bins=bins, min_leaf=min_leaf, trees=trees, mtry=mtry,
                  seed=cfg.seed)
    out = predict(panel, forest, fold)
    out = out.withColumn("e_raw", F.coalesce("e_raw", F.lit(0.5)))
    out = out.withColumn("e", propensity("e_raw", cfg.trim, cfg.ps_clip))
    if rules is None:
        return out.drop("mu_all").withColumn("psi", aipw_psi("t", "y", "mu1", "mu0", "e"))
    status = arm_status(panel, rules, fold=fold)
    return route_arms(out, status, cfg, rules, pooled="mu_all", fold=fold).drop("mu_all")
