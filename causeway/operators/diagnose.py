"""Overlap and balance diagnostics over a nuisance table (``t, e`` + covariates).

Everything is a grouped aggregate.  KS needs cumulative counts in ``e``
order: rows are first collapsed to distinct ``e`` values (few for cell
learners, at most n otherwise), then a bucketed running sum gives the
cumulative distribution functions without a one-task window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.config import EPS, OVL_BINS, EffectConfig
from causeway.functions.scalar import weight_cap
from causeway.operators.joins import attach
from causeway.operators.order import exact_quantiles, ordered


# ------------------------------------------------------------------ weights
def arm_weights(estimand: str, cfg: EffectConfig) -> tuple[Column, Column]:
    """Diagnostic weights (treated-arm, control-arm) of an estimand."""
    t, e = F.col("t"), F.col("e")
    ec = F.least(F.greatest(e, F.lit(EPS)), F.lit(1 - EPS))
    if estimand == "ATE":
        return weight_cap(t / ec, cfg.weight_clip), weight_cap((1 - t) / (1 - ec), cfg.weight_clip)
    if estimand == "ATT":
        return F.lit(1.0), weight_cap((1 - t) * (e / (1 - e)), cfg.weight_clip)
    if estimand == "ATO":
        return weight_cap(t * (1 - e), cfg.weight_clip), weight_cap((1 - t) * e, cfg.weight_clip)
    raise ValueError(estimand)


# ----------------------------------------------------------------- overlap
def ks_statistic(nuis: DataFrame, group: Sequence[str] = (), score: str = "e") -> DataFrame:
    """Two-sample KS of the score between arms.

    ``ks``: the textbook statistic, max over distinct values of |F1 − F0|.
    ``ks_reference``: the merge walk that advances treated first on ties,
    i.e. also evaluates |F1(≤v) − F0(<v)|; it overstates under ties.
    """
    group = list(group)
    by_value = nuis.where(F.col(score).isNotNull()).groupBy(*group, score).agg(
        F.count(F.when(F.col("t") == 1, 1)).alias("c1"),
        F.count(F.when(F.col("t") == 0, 1)).alias("c0"))
    run = ordered(by_value, score, True, score, group, sums=["c1", "c0"], pos_col="_p")
    tot = by_value.groupBy(*group).agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"))
    run = attach(run, tot, group)
    f1 = F.col("cum_c1") / F.col("n1")
    f0 = F.col("cum_c0") / F.col("n0")
    f0_before = (F.col("cum_c0") - F.col("c0")) / F.col("n0")
    ok = (F.col("n1") > 0) & (F.col("n0") > 0)
    return run.groupBy(*group).agg(
        F.max(F.when(ok, F.abs(f1 - f0))).alias("ks"),
        F.max(F.when(ok, F.greatest(F.abs(f1 - f0), F.abs(f1 - f0_before)))).alias("ks_reference"))


def ovl_coefficient(nuis: DataFrame, group: Sequence[str] = (), bins: int = OVL_BINS) -> DataFrame:
    """Overlap coefficient: Σ over equal-width bins of min(treated share, control share)."""
    group = list(group)
    e = F.col("e")
    b = F.least(F.floor(e * bins), F.lit(bins - 1)).cast("int")
    counts = nuis.where(e.isNotNull() & (e >= 0) & (e <= 1)).groupBy(*group, b.alias("bin")).agg(
        F.count(F.when(F.col("t") == 1, 1)).alias("c1"),
        F.count(F.when(F.col("t") == 0, 1)).alias("c0"))
    tot = counts.groupBy(*group).agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"))
    j = attach(counts, tot, group)
    return j.groupBy(*group).agg(F.sum(F.least(F.col("c1") / F.col("n1"),
                                               F.col("c0") / F.col("n0"))).alias("ovl"),
                                 F.first("n1").alias("_n1"), F.first("n0").alias("_n0")) \
        .select(*group, F.when((F.col("_n1") > 0) & (F.col("_n0") > 0), F.col("ovl")).alias("ovl"))


def ess_ratio(nuis: DataFrame, estimand: str, cfg: EffectConfig,
              group: Sequence[str] = ()) -> DataFrame:
    """Effective sample size share per arm: (Σw)² / Σw² / n_arm."""
    w_t, w_c = arm_weights(estimand, cfg)
    t = F.col("t")

    def ess(w: Column, arm: int) -> Column:
        sel = t == arm
        sw = F.sum(F.when(sel, w))
        sww = F.sum(F.when(sel, w * w))
        n = F.count(F.when(sel, 1))
        return F.when(n > 0, (sw * sw) / (sww + EPS) / (n + EPS))

    ess_t = F.lit(None).cast("double") if estimand == "ATT" else ess(w_t, 1)
    return nuis.groupBy(*group).agg(ess_t.alias("ess_t"), ess(w_c, 0).alias("ess_c"))


def weight_tails(nuis: DataFrame, estimand: str, cfg: EffectConfig,
                 group: Sequence[str] = ()) -> DataFrame:
    """Exact 99th percentile (and max) of the diagnostic weights per arm."""
    group = list(group)
    w_t, w_c = arm_weights(estimand, cfg)
    arms = nuis.select(*group, "id", "t", F.when(F.col("t") == 1, w_t).otherwise(w_c).alias("w"))
    if estimand == "ATT":
        arms = arms.where(F.col("t") == 0)
    q = exact_quantiles(arms, "w", [0.99], group + ["t"])
    mx = arms.groupBy(*group, "t").agg(F.max("w").alias("w_max"))
    return q.join(mx, group + ["t"]).select(*group, F.col("t").alias("arm"),
                                            F.col("q").alias("w_p99"), "w_max")


# ----------------------------------------------------------------- balance
def smd_table(nuis: DataFrame, features: Sequence[str], estimand: str, cfg: EffectConfig,
              group: Sequence[str] = ()) -> DataFrame:
    """Standardised mean differences of every feature, long form
    ``group…, feature, smd``; one aggregate for all features.

    Means and variances are weighted (population form, ε = 1e-12); for ATT
    the treated arm is unweighted.  Rows with a NULL feature value are left
    out of that feature.  Sums are taken around each feature's overall mean
    (a one-row aggregate first), so a large offset, as of a timestamp, costs
    no precision.
    """
    group = list(group)
    w_t, w_c = arm_weights(estimand, cfg)
    t = F.col("t")
    centre = nuis.agg(*[F.coalesce(F.avg(F.col(f).cast("double")), F.lit(0.0)).alias(f"{f}__centre") for f in features])
    nuis = nuis.join(F.broadcast(centre))   # one row
    aggs = []
    for f in features:
        x = F.col(f).cast("double") - F.col(f"{f}__centre")
        for arm, w in ((1, w_t), (0, w_c)):
            sel = (t == arm) & x.isNotNull()
            aggs += [F.sum(F.when(sel, w)).alias(f"{f}__sw{arm}"),
                     F.sum(F.when(sel, w * x)).alias(f"{f}__sx{arm}"),
                     F.sum(F.when(sel, w * x * x)).alias(f"{f}__sxx{arm}"),
                     F.count(F.when(sel, 1)).alias(f"{f}__n{arm}")]
    wide = nuis.groupBy(*group).agg(*aggs)
    rows = []
    for f in features:
        stats = {}
        for arm in (1, 0):
            sw, sx, sxx, n = (F.col(f"{f}__sw{arm}"), F.col(f"{f}__sx{arm}"),
                              F.col(f"{f}__sxx{arm}"), F.col(f"{f}__n{arm}"))
            if estimand == "ATT" and arm == 1:
                m = sx / n
                v = sxx / n - m * m
            else:
                m = sx / (sw + EPS)
                v = (sxx - 2 * m * sx + m * m * sw) / (sw + EPS)
            stats[arm] = (m, F.greatest(v, F.lit(0.0)), n)
        (m1, v1, n1), (m0, v0, n0) = stats[1], stats[0]
        pooled = F.sqrt((v1 + v0) / 2.0 + EPS)
        smd = F.when((n1 > 0) & (n0 > 0), (m1 - m0) / (pooled + EPS))
        rows.append(F.struct(F.lit(f).alias("feature"), smd.alias("smd")))
    return wide.select(*group, F.explode(F.array(*rows)).alias("_r")).select(*group, "_r.*")


def smd_top(smd: DataFrame, k: int = 10, group: Sequence[str] = ()) -> DataFrame:
    """Most imbalanced features: |SMD| descending (ties by name), top k per group."""
    from pyspark.sql import Window

    w = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(
        F.abs("smd").desc(), F.col("feature"))
    return (smd.where(F.col("smd").isNotNull())
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


def smd_max(smd: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return smd.groupBy(*group).agg(F.max(F.abs("smd")).alias("smd_max"))


# ------------------------------------------------------------- band, summary
def band_coverage(nuis: DataFrame, lo: float, hi: float, group: Sequence[str] = ()) -> DataFrame:
    """Rows with lo ≤ e ≤ hi: count, share, and arm counts inside."""
    inb = F.col("e").between(lo, hi)
    return nuis.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(inb, 1)).alias("n_band"),
        F.count(F.when(inb & (F.col("t") == 1), 1)).alias("n_band_treated"),
        F.count(F.when(inb & (F.col("t") == 0), 1)).alias("n_band_control"),
    ).withColumn("coverage", F.col("n_band") / F.col("n"))


def propensity_summary(nuis: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return nuis.groupBy(*group).agg(F.avg("e").alias("e_mean"), F.min("e").alias("e_min"),
                                    F.max("e").alias("e_max"))
