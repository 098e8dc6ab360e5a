"""Saturated cell-mean nuisances, cross-fitted by "total minus own fold".

Within a cell of discrete covariates the propensity is the treated share and
each arm's outcome model is the arm mean, both taken over the *other* folds.
One grouped pass over the rows gives per (group, fold, cell) sufficient
statistics; the out-of-fold statistics are the cell totals minus the own
fold's share, so k folds cost one aggregate, not k fits.

Fallbacks (a cell empty in the training folds, or an arm empty in it):
propensity → the training folds' treated share → 0.5; arm mean → the arm
mean over all cells of the training folds → 0.0 when the arm is absent.

``y_scale`` (e.g. 2 for money) sums ``round(y·10^scale)`` as BIGINT, so the
statistics are exact and independent of summation order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.config import EffectConfig
from causeway.functions.scalar import aipw_psi, propensity
from causeway.operators.joins import join_null_safe, join_small

STAT_COLS = ("n1", "n0", "m1", "m0", "s1", "s0")


def _y_term(y: Column, y_scale: int | None) -> Column:
    if y_scale is None:
        return y.cast("double")
    return F.round(y * F.lit(10.0 ** y_scale)).cast("bigint")


def _y_value(s: Column, y_scale: int | None) -> Column:
    if y_scale is None:
        return s
    return s.cast("double") / F.lit(10.0 ** y_scale)


def cell_stats(panel: DataFrame, cell: Column | str, group: Sequence[str] = (),
               t: str = "t", y: str = "y", fold: str = "fold",
               y_scale: int | None = None) -> DataFrame:
    """Per (group, fold, cell) counts and outcome sums by arm."""
    c = F.col(cell) if isinstance(cell, str) else cell
    tc, yc = F.col(t), F.col(y)
    yt = _y_term(yc, y_scale)
    zero = F.lit(0).cast("bigint") if y_scale is not None else F.lit(0.0)
    return (panel.select(*group, fold, c.alias("cell"), tc.alias("_t"), yt.alias("_y"))
            .groupBy(*group, fold, "cell").agg(
                F.count(F.when(F.col("_t") == 1, 1)).alias("n1"),
                F.count(F.when(F.col("_t") == 0, 1)).alias("n0"),
                F.count(F.when((F.col("_t") == 1) & F.col("_y").isNotNull(), 1)).alias("m1"),
                F.count(F.when((F.col("_t") == 0) & F.col("_y").isNotNull(), 1)).alias("m0"),
                F.coalesce(F.sum(F.when(F.col("_t") == 1, F.col("_y"))), zero).alias("s1"),
                F.coalesce(F.sum(F.when(F.col("_t") == 0, F.col("_y"))), zero).alias("s0"),
            ))


def oof_table(stats: DataFrame, cfg: EffectConfig, group: Sequence[str] = (),
              fold: str = "fold", y_scale: int | None = None) -> DataFrame:
    """Out-of-fold ``e_raw, e, mu1, mu0`` per (group, fold, cell)."""
    group = list(group)
    w_cell = Window.partitionBy(*group, "cell")
    own = [F.col(c).alias("o_" + c) for c in STAT_COLS]
    of_cell = [F.sum(c).over(w_cell).alias("c_" + c) for c in STAT_COLS]
    if group:
        # one exchange on the group keys serves all three windows
        w_fold, w_all = Window.partitionBy(*group, fold), Window.partitionBy(*group)
        t = stats.repartition(*group).select(
            *group, fold, "cell", *own, *of_cell,
            *[F.sum(c).over(w_fold).alias("f_" + c) for c in STAT_COLS],
            *[F.sum(c).over(w_all).alias("a_" + c) for c in STAT_COLS])
    else:
        # cells stay spread; fold and overall totals are one row per fold
        totals = (stats.groupBy(fold).agg(*[F.sum(c).alias("f_" + c) for c in STAT_COLS])
                  .select("*", *[F.sum("f_" + c).over(Window.partitionBy()).alias("a_" + c) for c in STAT_COLS]))
        t = join_null_safe(stats.select(fold, "cell", *own, *of_cell), F.broadcast(totals), [fold])

    def tr(c: str, scope: str) -> Column:
        own = F.col("o_" + c) if scope == "c_" else F.col("f_" + c)
        return F.col(scope + c) - own

    n1c, n0c, m1c, m0c = tr("n1", "c_"), tr("n0", "c_"), tr("m1", "c_"), tr("m0", "c_")
    s1c, s0c = tr("s1", "c_"), tr("s0", "c_")
    n1a, n0a, m1a, m0a = tr("n1", "a_"), tr("n0", "a_"), tr("m1", "a_"), tr("m0", "a_")
    s1a, s0a = tr("s1", "a_"), tr("s0", "a_")

    e_raw = (F.when(n1c + n0c > 0, n1c.cast("double") / (n1c + n0c))
             .when(n1a + n0a > 0, n1a.cast("double") / (n1a + n0a))
             .otherwise(F.lit(0.5)))
    mu1 = (F.when(m1c > 0, _y_value(s1c, y_scale) / m1c)
           .when(m1a > 0, _y_value(s1a, y_scale) / m1a).otherwise(F.lit(0.0)))
    mu0 = (F.when(m0c > 0, _y_value(s0c, y_scale) / m0c)
           .when(m0a > 0, _y_value(s0a, y_scale) / m0a).otherwise(F.lit(0.0)))
    return t.select(*group, fold, "cell", e_raw.alias("e_raw"),
                    propensity(e_raw, cfg.trim, cfg.ps_clip).alias("e"),
                    mu1.alias("mu1"), mu0.alias("mu0"))


def strata_nuisance(panel: DataFrame, cell: Column | str, cfg: EffectConfig,
                    group: Sequence[str] = (), t: str = "t", y: str = "y",
                    fold: str = "fold", y_scale: int | None = None) -> DataFrame:
    """Row-level nuisance table: panel columns + cell, e_raw, e, mu1, mu0, psi."""
    group = list(group)
    c = F.col(cell) if isinstance(cell, str) else cell
    rows = panel.withColumn("cell", c)
    stats = cell_stats(rows, "cell", group, t, y, fold, y_scale)
    oof = oof_table(stats, cfg, group, fold, y_scale)
    out = join_small(rows, oof, group + [fold, "cell"], "left", source=panel)
    return out.withColumn("psi", aipw_psi(t, y, "mu1", "mu0", "e"))
