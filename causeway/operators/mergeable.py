"""Effects from mergeable statistics.

The cross-fitted cell learner and its ATE / ATT / ATO with standard errors are
functions of per (group, fold, cell) counts, outcome sums and sums of squares
by arm.  Such tables add up: the statistics of two deliveries of a campaign,
summed, are those of both together, so late rows update a result without a
second look at the earlier rows (and the folds are a hash of the id, so each
row's fold is the same whenever it arrives).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.config import EPS, Z975, EffectConfig
from causeway.functions.scalar import weight_cap
from causeway.operators.joins import join_null_safe
from causeway.operators.nuisance.strata import STAT_COLS, _y_term, cell_stats, oof_table

SQUARES = ("q1", "q0")


def effect_stats(panel: DataFrame, cell: Column | str, group: Sequence[str] = (), fold: str = "fold",
                 y_scale: int | None = None) -> DataFrame:
    """``group…, fold, cell``, the counts and sums of the cell learner, and the
    sums of squares ``q1, q0`` (exact, as decimals, where ``y_scale`` is given)."""
    c = F.col(cell) if isinstance(cell, str) else cell
    rows = panel.withColumn("cell", c)
    y = _y_term(F.col("y"), y_scale)
    square = (y.cast("decimal(19,0)") * y.cast("decimal(19,0)")).cast("decimal(38,0)") if y_scale is not None else y * y
    zero = F.lit(0).cast("decimal(38,0)") if y_scale is not None else F.lit(0.0)
    keys = [*group, fold, "cell"]
    sums = rows.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col("t") == a, square)), zero).alias(f"q{a}") for a in (1, 0)])
    return join_null_safe(cell_stats(rows, "cell", group, fold=fold, y_scale=y_scale), sums, keys)


def merge_stats(stats: DataFrame, group: Sequence[str] = (), fold: str = "fold") -> DataFrame:
    """The statistics of all deliveries together."""
    return stats.groupBy(*group, fold, "cell").agg(*[F.sum(c).alias(c) for c in (*STAT_COLS, *SQUARES)])


def effects_from_stats(stats: DataFrame, cfg: EffectConfig, group: Sequence[str] = (), fold: str = "fold",
                       y_scale: int | None = None) -> DataFrame:
    """``group…, estimand, n, n_treated, n_control, est, se, ci_lo, ci_hi``: the
    effect tables of the rows behind the statistics."""
    group = list(group)
    j = join_null_safe(stats, oof_table(stats, cfg, group, fold, y_scale), [*group, fold, "cell"])
    scale = 10.0 ** y_scale if y_scale is not None else 1.0
    e, mu1, mu0 = F.col("e"), F.col("mu1"), F.col("mu0")
    n1, n0 = F.col("m1").cast("double"), F.col("m0").cast("double")
    s1, s0 = F.col("s1").cast("double") / scale, F.col("s0").cast("double") / scale
    q1, q0 = F.col("q1").cast("double") / scale ** 2, F.col("q0").cast("double") / scale ** 2

    def about(n: Column, s: Column, q: Column, m: Column) -> tuple[Column, Column]:
        """Sum and sum of squares of y - m."""
        return s - n * m, q - 2 * m * s + n * m * m

    a1, b1 = about(n1, s1, q1, mu1)
    a0, b0 = about(n0, s0, q0, mu0)
    c1, d1 = about(n1, s1, q1, mu0)
    d, r = mu1 - mu0, e / (1 - e)
    psi = a1 / e - a0 / (1 - e) + (n1 + n0) * d
    psi2 = b1 / (e * e) + 2 * d * a1 / e + b0 / ((1 - e) * (1 - e)) - 2 * d * a0 / (1 - e) + (n1 + n0) * d * d
    w = weight_cap(F.lit(4.0) * e * (1 - e), cfg.weight_clip)
    terms = {"n": n1 + n0, "n1": n1, "n0": n0, "p": psi, "pp": psi2, "a": c1 - r * a0, "aa": d1 + r * r * b0, "a1": c1,
             "w": w * (n1 + n0), "ww": w * w * (n1 + n0), "wp": w * psi, "wwp": w * w * psi, "wwpp": w * w * psi2}
    t = j.groupBy(*group).agg(*[F.sum(x).alias(f"_{k}") for k, x in terms.items()])
    n, s = F.col("_n"), {k: F.col(f"_{k}") for k in terms}

    def var(xx: Column, x: Column) -> Column:
        return F.greatest((xx - x * x / n) / (n - 1), F.lit(0.0))

    def cov(xy: Column, x: Column, y: Column) -> Column:
        return (xy - x * y / n) / (n - 1)

    ate = s["p"] / n
    p1 = s["n1"] / n + EPS
    att = (s["a"] / n) / p1
    att_var = (var(s["aa"], s["a"]) + att * att * var(s["n1"], s["n1"]) - 2 * att * cov(s["a1"], s["a"], s["n1"])) / (p1 * p1)
    ato = s["wp"] / (s["w"] + EPS)
    mean_w = s["w"] / n + EPS
    ato_var = (var(s["wwpp"], s["wp"]) + ato * ato * var(s["ww"], s["w"])
               - 2 * ato * cov(s["wwp"], s["wp"], s["w"])) / (mean_w * mean_w)
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("estimand"), est.alias("est"), F.when(n > 1, F.sqrt(F.greatest(v, F.lit(0.0)) / n)).alias("se"))
        for name, est, v in (("ATE", ate, var(s["pp"], s["p"])), ("ATT", att, att_var), ("ATO", ato, ato_var))]))
    out = t.where(n > 0).select(*group, n.cast("long").alias("n"), s["n1"].cast("long").alias("n_treated"),
                                s["n0"].cast("long").alias("n_control"), rows.alias("_e"))
    out = out.select(*group, "_e.estimand", "n", "n_treated", "n_control", "_e.est", "_e.se")
    return out.select("*", (F.col("est") - Z975 * F.col("se")).alias("ci_lo"), (F.col("est") + Z975 * F.col("se")).alias("ci_hi"))
