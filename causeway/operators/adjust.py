"""Variance reduction and corrections documented for the estimators:
CUPED residualisation, inverse probability of censoring weights for a
partly missing outcome, a one-step TMLE targeting of the outcome models, and
trimming sensitivity.  Each is a cross-fitted sufficient-statistic aggregate
(total minus own fold) plus row expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.config import Z975
from causeway.operators.joins import attach, join_null_safe, join_small, keep
from causeway.operators.order import weighted_quantiles


def cuped(panel: DataFrame, x: str, y: str = "y", fold: str = "fold",
          group: Sequence[str] = ()) -> DataFrame:
    """Row-level ``y_cuped = y − θ_f·(x − x̄_f)``: θ_f and x̄_f are the pooled
    slope and covariate mean of the *other* folds (no own-row leakage)."""
    group = list(group)
    # sums around the overall means (one row): a large offset costs no precision
    centre = panel.agg(F.coalesce(F.avg(F.col(x).cast("double")), F.lit(0.0)).alias("_cx"),
                       F.coalesce(F.avg(F.col(y).cast("double")), F.lit(0.0)).alias("_cy"))
    columns = panel.columns
    source, panel = panel, panel.join(F.broadcast(centre))
    xc, yc = F.col(x).cast("double") - F.col("_cx"), F.col(y).cast("double") - F.col("_cy")
    ok = xc.isNotNull() & yc.isNotNull()
    own = panel.groupBy(*group, fold).agg(
        F.count(F.when(ok, 1)).alias("_n"), F.sum(F.when(ok, xc)).alias("_sx"),
        F.sum(F.when(ok, yc)).alias("_sy"), F.sum(F.when(ok, xc * yc)).alias("_sxy"),
        F.sum(F.when(ok, xc * xc)).alias("_sxx"))
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    cols = ["_n", "_sx", "_sy", "_sxy", "_sxx"]
    tr = own.select(*group, fold, *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in cols])
    n = F.col("_n")
    mx, my = F.try_divide(F.col("_sx"), n), F.try_divide(F.col("_sy"), n)
    sxy = F.col("_sxy") - n * mx * my
    sxx = F.col("_sxx") - n * mx * mx
    coef = tr.select(*group, fold, F.when(sxx > 0, sxy / sxx).otherwise(F.lit(0.0)).alias("theta"),
                     mx.alias("x_mean"))
    out = join_small(panel, coef, group + [fold], "left", source=source)
    return (out.withColumn("y_cuped", F.col(y).cast("double") - F.col("theta") * (xc - F.col("x_mean")))
            .withColumn("x_mean", F.col("x_mean") + F.col("_cx")).select(*columns, "theta", "x_mean", "y_cuped"))


def cuped_summary(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Arm difference of y and of y_cuped, and the variance reduction."""
    t = F.col("t")
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.when(t == 1, F.col("y"))) - F.avg(F.when(t == 0, F.col("y")))).alias("diff"),
        (F.avg(F.when(t == 1, F.col("y_cuped"))) - F.avg(F.when(t == 0, F.col("y_cuped")))).alias("diff_cuped"),
        (1 - F.var_samp("y_cuped") / F.var_samp("y")).alias("var_reduction"))


def ipcw_weights(nuis: DataFrame, observed: Column, cell: Column | str, fold: str = "fold",
                 group: Sequence[str] = (), trim: float = 0.01) -> DataFrame:
    """``pi`` = out-of-fold share of observed outcomes in the (cell, arm) — the
    training folds' share where there is none — at least ``trim``; ``w_ipcw`` =
    R / pi.  ``observed`` is a flag of its own, never a function of the outcome."""
    group = list(group)
    rows = nuis.withColumn("_r", observed.cast("int")).withColumn("_cell", F.col(cell) if isinstance(cell, str) else cell)
    own = rows.groupBy(*group, fold, "_cell", "t").agg(F.sum("_r").alias("_o"), F.count(F.lit(1)).alias("_m"))
    wc = Window.partitionBy(*group, "_cell", "t")
    wa = Window.partitionBy(*group) if group else Window.partitionBy()
    totals = (own.groupBy(*group, fold).agg(F.sum("_o").alias("_fo"), F.sum("_m").alias("_fm"))
              .select(*group, fold, (F.sum("_fo").over(wa) - F.col("_fo")).alias("_ao"),
                      (F.sum("_fm").over(wa) - F.col("_fm")).alias("_am")))
    cells = own.select(*group, fold, "_cell", "t", (F.sum("_o").over(wc) - F.col("_o")).alias("_co"),
                       (F.sum("_m").over(wc) - F.col("_m")).alias("_cm"))
    pi = (F.when(F.col("_cm") > 0, F.col("_co") / F.col("_cm"))
          .when(F.col("_am") > 0, F.col("_ao") / F.col("_am")).otherwise(F.lit(1.0)))
    tab = (join_null_safe(cells, totals, [*group, fold])
           .select(*group, fold, "_cell", "t", F.greatest(pi, F.lit(trim)).alias("pi")))
    out = join_null_safe(rows, tab, [*group, fold, "_cell", "t"], how="left").drop("_cell")
    return out.withColumn("w_ipcw", F.when(F.col("_r") == 1, 1.0 / F.col("pi")).otherwise(F.lit(0.0))).drop("_r")


def ipcw_ate(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Doubly robust ATE with a partly missing outcome: the mean over all rows of
    μ1 − μ0 + w·(t(y − μ1)/e − (1 − t)(y − μ0)/(1 − e)), the residual part only
    for observed rows.  Expects μ fitted on observed rows (``y`` NULL elsewhere)."""
    w, t, y, e = F.col("w_ipcw"), F.col("t"), F.col("y"), F.col("e")
    residual = t * (y - F.col("mu1")) / e - (1 - t) * (y - F.col("mu0")) / (1 - e)
    inf = F.col("mu1") - F.col("mu0") + F.when(w > 0, w * residual).otherwise(F.lit(0.0))
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(w > 0, 1)).alias("n_observed"),
        F.avg(inf).alias("est_ipcw"), (F.stddev_samp(inf) / F.sqrt(F.count(F.lit(1)))).alias("se_ipcw"))


def tmle_step(nuis: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """One linear fluctuation along the clever covariate H = t/e − (1 − t)/(1 − e):
    ε = Σ H·(y − μ_t) / Σ H²; μ1* = μ1 + ε/e, μ0* = μ0 − ε/(1 − e).
    Returns ``group…, n, epsilon, est, se, ci_lo, ci_hi`` (SE from the AIPW
    influence function of the targeted fit)."""
    group = list(group)
    t, e, y = F.col("t"), F.col("e"), F.col("y")
    h = t / e - (1 - t) / (1 - e)
    mu_t = F.when(t == 1, F.col("mu1")).otherwise(F.col("mu0"))
    eps = nuis.groupBy(*group).agg((F.sum(h * (y - mu_t)) / F.sum(h * h)).alias("epsilon"))
    j = attach(nuis, eps, group)
    m1 = F.col("mu1") + F.col("epsilon") / e
    m0 = F.col("mu0") - F.col("epsilon") / (1 - e)
    inf = t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e) + (m1 - m0)
    agg = j.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.first("epsilon").alias("epsilon"),
                                F.avg(m1 - m0).alias("est"), F.stddev_samp(inf).alias("_sd"))
    se = F.col("_sd") / F.sqrt("n")
    return agg.select(*group, "n", "epsilon", "est", se.alias("se"),
                      (F.col("est") - Z975 * se).alias("ci_lo"), (F.col("est") + Z975 * se).alias("ci_hi"))


def trim_sensitivity(nuis: DataFrame, bands: Sequence[tuple[float, float]], group: Sequence[str] = (),
                     tails: Sequence[float] = (0.95, 0.99)) -> DataFrame:
    """ATE on the rows whose propensity lies in each band, and the tails of |ψ|
    there: the largest and the quantiles ``tails`` (``psi_p95``, …).

    One scan: the bands' edges cut [0, 1] into intervals and single points, and
    rows are counted by (interval, |ψ|).  A band is a stretch of intervals, so
    its moments are sums over them and its quantiles those of its counts."""
    group = list(group)
    edges = sorted({float(v) for band in bands for v in band})
    points = F.array(*[F.lit(v) for v in edges])
    e = F.col("e")
    # even numbers are the open intervals between edges, odd ones the edges
    place = 2 * F.size(F.filter(points, lambda v: v < e)) + F.array_contains(points, e).cast("int")
    counted = keep(nuis.where(F.col("psi").isNotNull() & e.isNotNull()).select(*group, place.alias("_at"), "psi")
                   .groupBy(*group, "_at", F.abs("psi").alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.sum("psi").alias("_s")))
    spans = [F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"),
                      F.lit(2 * edges.index(float(lo)) + 1).alias("a"), F.lit(2 * edges.index(float(hi)) + 1).alias("b"))
             for lo, hi in bands]
    inside = (counted.withColumn("_band", F.explode(F.array(*spans)))
              .where(F.col("_at").between(F.col("_band.a"), F.col("_band.b")))
              .select(*group, "_band.lo", "_band.hi", "_v", "_c", "_s"))
    keys = [*group, "lo", "hi"]
    n, s = F.sum("_c"), F.sum("_s")
    square = F.sum(F.col("_c") * F.col("_v") * F.col("_v"))
    stats = inside.groupBy(*keys).agg(
        n.alias("n_kept"), (s / n).alias("est"),
        F.when(n > 1, F.sqrt(F.greatest((square - s * s / n) / (n - 1), F.lit(0.0)) / n)).alias("se"),
        F.max("_v").alias("psi_abs_max"))
    q = weighted_quantiles(inside, "_v", "_c", tails, keys)
    wide = q.groupBy(*keys).agg(*[F.max(F.when(F.abs(F.col("p") - p) < 1e-9, F.col("q"))).alias(f"psi_p{round(100 * p)}")
                                  for p in tails])
    out = join_null_safe(stats, wide, keys)
    if group:
        return out
    # a band without rows is stated too
    listed = nuis.sparkSession.createDataFrame([(float(lo), float(hi)) for lo, hi in bands], "lo double, hi double").distinct()
    return join_null_safe(listed, out, keys, how="left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
