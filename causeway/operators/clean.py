"""Cleaning steps around the estimators: median imputation, finite filters,
degenerate-prediction repair, overlap-band fallbacks and the validity gate
of the ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.joins import attach, join_null_safe
from causeway.operators.order import exact_quantiles


def impute_median(df: DataFrame, col: str, group: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """NULL → the (exact, linear-interpolated) median of the column."""
    group = list(group)
    med = exact_quantiles(df, col, [0.5], group).select(*group, F.col("q").alias("_med"))
    j = attach(df, med, group)
    return j.withColumn(out or col, F.coalesce(F.col(col), F.col("_med"))).drop("_med")


def finite(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose columns are all non-NULL and not ±∞/NaN."""
    cond = F.lit(True)
    for c in cols:
        x = F.col(c)
        cond = cond & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return df.where(cond)


def repair_predictions(df: DataFrame, fold: str = "fold", y: str = "y", t: str = "t") -> DataFrame:
    """Non-finite μ̂ → the arm mean of the training folds (total − own fold)."""
    own = {(r[0], r[1]): (r["s"], r["n"]) for r in df.groupBy(fold, t).agg(
        F.sum(F.col(y).cast("double")).alias("s"), F.count(y).alias("n")).collect()}  # ≤ folds × 2 rows
    folds = sorted({f for f, _ in own if f is not None})
    out = df
    for arm, col in ((1, "mu1"), (0, "mu0")):
        repl = F.lit(0.0)  # no training row of the arm
        for f in folds:
            rest = [own[g, arm] for g in folds if g != f and (g, arm) in own]
            n = sum(k for _, k in rest)
            if n:
                repl = F.when(F.col(fold) == f, sum(s for s, k in rest if k) / n).otherwise(repl)
        bad = F.col(col).isNull() | F.isnan(col) | (F.abs(col) == float("inf"))
        out = out.withColumn(col, F.when(bad, repl).otherwise(F.col(col)))
    return out


def band_choice(nuis: DataFrame, band: tuple[float, float], k: int, base: tuple[float, float] = (0.1, 0.9),
                group: Sequence[str] = ()) -> DataFrame:
    """Overlap-band fallbacks: a band with fewer than max(50, 3k) rows or a
    single arm → keep all rows ('all'); fewer than max(100, 3k) → the base
    band ('base'); otherwise the band itself ('band').  The 'note' column
    says when an estimator should refuse instead."""
    lo, hi = band
    inb = F.col("e").between(lo, hi)
    s = nuis.groupBy(*group).agg(
        F.count(F.when(inb, 1)).alias("n_band"),
        F.count(F.when(inb & (F.col("t") == 1), 1)).alias("n_band_treated"),
        F.count(F.when(inb & (F.col("t") == 0), 1)).alias("n_band_control"),
        F.count(F.lit(1)).alias("n"))
    one_arm = (F.col("n_band_treated") == 0) | (F.col("n_band_control") == 0)
    choice = (F.when((F.col("n_band") < max(50, 3 * k)) | one_arm, F.lit("all"))
              .when(F.col("n_band") < max(100, 3 * k), F.lit("base")).otherwise(F.lit("band")))
    note = F.when((F.col("n_band") < max(50, 3 * k)) | one_arm, F.lit("band too small or one arm"))
    return s.select(*group, "n", "n_band", "n_band_treated", "n_band_control",
                    choice.alias("choice"), note.alias("note"),
                    F.when(choice == "band", F.lit(lo)).when(choice == "base", F.lit(base[0]))
                    .otherwise(F.lit(0.0)).alias("lo"),
                    F.when(choice == "band", F.lit(hi)).when(choice == "base", F.lit(base[1]))
                    .otherwise(F.lit(1.0)).alias("hi"))


def validity_gate(df: DataFrame, k: int, cols: Sequence[str] = ("psi", "tau"),
                  group: Sequence[str] = ()) -> DataFrame:
    """Rows with every score present; fewer than max(30, 2k) → a note (the
    ranking metrics are then reported as 0 / NULL)."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    s = df.groupBy(*group).agg(F.count(F.when(ok, 1)).alias("n_valid"))
    return s.withColumn("valid", F.col("n_valid") >= max(30, 2 * k)) \
            .withColumn("note", F.when(~F.col("valid"), F.lit("too few valid out-of-fold points")))


def banded(nuis: DataFrame, band: tuple[float, float], k: int, base: tuple[float, float] = (0.1, 0.9),
           group: Sequence[str] = ()) -> DataFrame:
    """The rows inside the overlap band, or what :func:`band_choice` falls back
    to where the band is too small: the base band, or all rows."""
    group = list(group)
    choice = band_choice(nuis, band, k, base, group).select(*group, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    j = join_null_safe(nuis, choice, group) if group else nuis.crossJoin(F.broadcast(choice))   # one row
    return j.where(F.col("e").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def gated(metrics: DataFrame, df: DataFrame, k: int, cols: Sequence[str] = ("psi", "tau"),
          group: Sequence[str] = (), zero: bool = False) -> DataFrame:
    """Ranking metrics behind the validity gate: where too few rows have both
    scores every metric is NULL (or 0) and ``note`` says why."""
    group = list(group)
    gate = validity_gate(df, k, cols, group).select(*group, "valid", "note", "n_valid")
    j = join_null_safe(metrics, gate, group) if group else metrics.crossJoin(F.broadcast(gate))   # one row
    other = F.lit(0.0) if zero else F.lit(None).cast("double")
    values = {c for c, t in metrics.dtypes if t == "double"}
    return j.select(*group, *[F.when(F.col("valid"), F.col(c)).otherwise(other).alias(c) if c in values else F.col(c)
                              for c in metrics.columns if c not in group], "n_valid", "note")
