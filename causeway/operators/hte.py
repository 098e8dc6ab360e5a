"""Heterogeneous effects from doubly robust scores.

* ``dr_segment``: the DR-learner with a saturated segment model — τ̂(x) is
  the mean ψ of the row's segment over the *other* folds (total minus own
  fold, one aggregate), with segment-level intervals.
* ``dr_forest``: the DR-learner with a forest regressing ψ on the features,
  trained on the overlap band and applied to every row, cross-fitted by fold.
* ``effect_intervals``: the forest's trees come in little bags that each train
  on half of the rows; the spread between bags gives bounds at 90 % and 99 %.
* ``label_shares``: significance labels among treated rows and their shares.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.config import Z975
from causeway.functions.scalar import significance_label
from causeway.operators.joins import join_null_safe, join_small
from causeway.operators.trees import Family, grow, predict

Z95 = 1.6448536269514722  # two-sided 90 % normal quantile
Z995 = 2.5758293035489004  # two-sided 99 % normal quantile


def dr_segment(nuis: DataFrame, segment: Column | str, group: Sequence[str] = (),
               fold: str = "fold", psi: str = "psi", out: str = "tau", train: Column | None = None) -> DataFrame:
    """Cross-fitted segment-mean τ̂: mean ψ of the segment in the other folds;
    learned from the rows ``train`` holds for (the overlap band), given to all."""
    group = list(group)
    seg = F.col(segment) if isinstance(segment, str) else segment
    rows = nuis.withColumn("_seg", seg)
    ok = F.col(psi).isNotNull() & (F.lit(True) if train is None else F.coalesce(train, F.lit(False)))
    own = rows.groupBy(*group, fold, "_seg").agg(
        F.sum(F.when(ok, F.col(psi))).alias("_os"), F.count(F.when(ok, 1)).alias("_on"))
    # Segment totals by a window per segment; fold and overall totals from a
    # second aggregate with one row per (group and) fold.
    w_seg = Window.partitionBy(*group, "_seg")
    w_all = Window.partitionBy(*group) if group else Window.partitionBy()
    totals = (own.groupBy(*group, fold).agg(F.sum("_os").alias("_fs"), F.sum("_on").alias("_fn"))
              .select("*", F.sum("_fs").over(w_all).alias("_as"), F.sum("_fn").over(w_all).alias("_an")))
    parts = own.select(*group, fold, "_seg", "_os", "_on",
                       F.sum("_os").over(w_seg).alias("_ts"), F.sum("_on").over(w_seg).alias("_tn"))
    t = join_null_safe(parts, totals if group else F.broadcast(totals), [*group, fold])
    n_tr = F.col("_tn") - F.col("_on")
    n_fb = F.col("_an") - F.col("_fn")
    tau = (F.when(n_tr > 0, (F.col("_ts") - F.coalesce(F.col("_os"), F.lit(0.0))) / n_tr)
           .when(n_fb > 0, (F.col("_as") - F.coalesce(F.col("_fs"), F.lit(0.0))) / n_fb)
           .otherwise(F.lit(0.0)))
    tab = t.select(*group, fold, "_seg", tau.alias(out))
    return join_small(rows, tab, group + [fold, "_seg"], "left", source=nuis).drop("_seg")


def segment_effects(nuis: DataFrame, segment: Column | str, group: Sequence[str] = (),
                    psi: str = "psi") -> DataFrame:
    """Per-segment mean ψ with normal 90/95/99 % bounds (HT1b, HT2)."""
    seg = F.col(segment) if isinstance(segment, str) else segment
    s = nuis.withColumn("segment", seg).where(F.col(psi).isNotNull()).groupBy(
        *group, "segment").agg(F.count(F.lit(1)).alias("n"), F.avg(psi).alias("tau"),
                               F.stddev_samp(psi).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return s.select(*group, "segment", "n", "tau", se.alias("se"),
                    (F.col("tau") - Z95 * se).alias("lb90"), (F.col("tau") + Z95 * se).alias("ub90"),
                    (F.col("tau") - Z975 * se).alias("lb95"), (F.col("tau") + Z975 * se).alias("ub95"),
                    (F.col("tau") - Z995 * se).alias("lb99"), (F.col("tau") + Z995 * se).alias("ub99"))


def label_shares(df: DataFrame, lb99: str = "lb99", lb90: str = "lb90",
                 group: Sequence[str] = ()) -> DataFrame:
    """Significance label counts and 4-decimal shares among treated rows."""
    group = list(group)
    lab = df.where(F.col("t") == 1).withColumn("label", significance_label(lb99, lb90))
    counts = lab.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(whole), 4))


# -------------------------------------------------------------- forest DR
def dr_forest(nuis: DataFrame, features: Sequence[str], cfg_band: tuple[float, float] | None,
              fold: str = "fold", psi: str = "psi", num_trees: int = 50, max_depth: int = 5, min_leaf: int = 20,
              seed: int = 42, out: str = "tau", bags: int = 0, bins: int = 32) -> DataFrame:
    """Cross-fitted forest on ψ: trained on the other folds' rows inside the
    band, applied to every row.  The forests of all folds grow together; with
    ``bags`` the trees come in little bags and ``<out>_sd`` is added."""
    where = F.col(psi).isNotNull()
    if cfg_band is not None:
        where = where & F.col("e").between(*cfg_band)
    folds = [r[0] for r in nuis.select(fold).distinct().collect()]
    forest = grow(nuis, features, [Family(out, F.col(psi), where)], folds, fold, depth=max_depth, trees=num_trees,
                  bags=bags, min_leaf=min_leaf, seed=seed, bins=bins)
    return predict(nuis, forest, fold, spread=bags > 0)


def effect_intervals(nuis: DataFrame, features: Sequence[str], band: tuple[float, float] | None,
                     fold: str = "fold", seed: int = 42, bags: int = 50, per_bag: int = 4, **kw) -> DataFrame:
    """τ̂ and its 90/99 % bounds from little bags: one forest per fold, all grown
    together, whose trees share half of the rows bag by bag; the variance
    between the bags' means, less what the few trees of a bag add, is that of
    τ̂(x).  One scoring pass gives the mean and the spread."""
    out = dr_forest(nuis, features, band, fold, num_trees=bags * per_bag, bags=bags, seed=seed, **kw)
    sd = F.col("tau_sd")
    return out.select("*", *[(F.col("tau") + sign * z * sd).alias(f"{side}{level}")
                             for z, level in ((Z95, 90), (Z995, 99)) for side, sign in (("lb", -1), ("ub", 1))])
