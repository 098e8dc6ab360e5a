"""Average-effect estimators over a nuisance table (one aggregate each).

The nuisance table has ``t, y, e, mu1, mu0, psi`` per row.  Each estimand's
point estimate and influence-function variance come out of a single grouped
aggregate: the influence function is linear in per-row terms, so its sample
variance follows from ``var_samp``/``covar_samp`` of those terms, no second
pass over the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.config import EPS, Z975, Z_TUNER, EffectConfig
from causeway.functions.scalar import weight_cap

ESTIMANDS = ("ATE", "ATT", "ATO")


def _att_term() -> Column:
    e, t, y, mu0 = F.col("e"), F.col("t"), F.col("y"), F.col("mu0")
    return t * (y - mu0) - (1 - t) * (e / (1 - e)) * (y - mu0)


def ato_weight(cfg: EffectConfig) -> Column:
    e = F.col("e")
    return weight_cap(F.lit(4.0) * e * (1 - e), cfg.weight_clip)


def effect_table(nuis: DataFrame, estimand: str, cfg: EffectConfig,
                 group: Sequence[str] = ()) -> DataFrame:
    """``group…, n, n_treated, n_control, est, se, ci_lo, ci_hi`` for one estimand,
    over the rows with an outcome."""
    estimand = estimand.upper()
    if estimand not in ESTIMANDS:
        raise ValueError(f"estimand must be one of {ESTIMANDS}")
    group = list(group)
    nuis = nuis.where(F.col("psi").isNotNull())  # rows without an outcome carry no influence
    t = F.col("t")
    counts = [F.count(F.lit(1)).alias("n"),
              F.count(F.when(t == 1, 1)).alias("n_treated"),
              F.count(F.when(t == 0, 1)).alias("n_control")]
    if estimand == "ATE":
        stats = nuis.groupBy(*group).agg(*counts, F.avg("psi").alias("est"),
                                         F.stddev_samp("psi").alias("_sd"))
        se = F.col("_sd") / F.sqrt("n")
    elif estimand == "ATT":
        term = _att_term()
        stats = nuis.groupBy(*group).agg(
            *counts, F.avg(term).alias("_mt"), F.avg(t).alias("_p1"),
            F.var_samp(term).alias("_va"), F.var_samp(t).alias("_vt"),
            F.covar_samp(term, t).alias("_cv"))
        stats = stats.withColumn("est", F.col("_mt") / (F.col("_p1") + EPS))
        var_if = (F.col("_va") + F.col("est") ** 2 * F.col("_vt")
                  - 2 * F.col("est") * F.col("_cv")) / (F.col("_p1") + EPS) ** 2
        se = F.sqrt(F.greatest(var_if, F.lit(0.0))) / F.sqrt("n")
    else:
        w = ato_weight(cfg)
        wpsi = w * F.col("psi")
        stats = nuis.groupBy(*group).agg(
            *counts, F.sum(wpsi).alias("_swp"), F.sum(w).alias("_sw"), F.avg(w).alias("_mw"),
            F.var_samp(wpsi).alias("_va"), F.var_samp(w).alias("_vw"),
            F.covar_samp(wpsi, w).alias("_cv"))
        stats = stats.withColumn("est", F.col("_swp") / (F.col("_sw") + EPS))
        var_if = (F.col("_va") + F.col("est") ** 2 * F.col("_vw")
                  - 2 * F.col("est") * F.col("_cv")) / (F.col("_mw") + EPS) ** 2
        se = F.sqrt(F.greatest(var_if, F.lit(0.0))) / F.sqrt("n")
    stats = stats.withColumn("se", se)
    return stats.select(*group, "n", "n_treated", "n_control", "est", "se",
                        (F.col("est") - Z975 * F.col("se")).alias("ci_lo"),
                        (F.col("est") + Z975 * F.col("se")).alias("ci_hi"))


def naive_difference(panel: DataFrame, group: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Difference of arm means (the unadjusted comparison)."""
    t = F.col("t")
    return panel.groupBy(*group).agg(
        F.avg(F.when(t == 1, F.col(y))).alias("mean_treated"),
        F.avg(F.when(t == 0, F.col(y))).alias("mean_control"),
    ).withColumn("naive_diff", F.col("mean_treated") - F.col("mean_control"))


def ci_width_normalised(nuis: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """2·1.96·sd(ψ)/√n divided by max(sd(y), 1e-8) — the tuner's CI penalty."""
    return nuis.where(F.col("psi").isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("psi").alias("sd_psi"),
        F.stddev_samp("y").alias("sd_y"),
    ).withColumn("ci_width", 2 * Z_TUNER * F.col("sd_psi") / F.sqrt("n")) \
     .withColumn("ci_width_norm", F.col("ci_width") / F.greatest(F.col("sd_y"), F.lit(1e-8)))


def fold_variance(nuis: DataFrame, group: Sequence[str] = (), fold: str = "fold") -> DataFrame:
    """Mean over folds of var(ψ)/n_fold (the variance-minimising objective)."""
    per_fold = nuis.groupBy(*group, fold).agg(
        F.try_divide(F.var_samp("psi"), F.count("psi")).alias("v"))
    return per_fold.groupBy(*group).agg(F.avg("v").alias("fold_variance"),
                                        F.count(F.lit(1)).alias("n_folds"))
