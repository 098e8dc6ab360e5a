"""Categorical encodings: one-hot, out-of-fold target encoding, count and
frequency encoding, weight of evidence.

All categorical columns are handled by *one* grouped pass: rows are stacked
to ``(column, level, …)`` pairs with ``explode`` and aggregated together; the
small per-level tables are joined back with a checked broadcast.  Output
column names follow the feature contract ``<col>__te``, ``<col>__count``,
``<col>__freq``, ``<col>__woe``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.config import TE_SMOOTHING
from causeway.functions.scalar import category
from causeway.operators.joins import attach, join_small


def levels_of(df: DataFrame, c: str, limit: int = 10_000) -> list[str]:
    """Sorted distinct levels of a categorical column (bounded, checked)."""
    vals = df.select(category(c).alias("v")).distinct().limit(limit + 1).collect()
    if len(vals) > limit:
        raise ValueError(f"column {c} has more than {limit} levels; one-hot is not suitable")
    return sorted(r["v"] for r in vals)


def one_hot(df: DataFrame, c: str, levels: Sequence[str] | None = None, drop_first: bool = True,
            prefix: str | None = None) -> DataFrame:
    """Dummy columns ``<prefix>_<level>`` (INT 0/1), first sorted level dropped."""
    lv = sorted(levels) if levels is not None else levels_of(df, c)
    if drop_first:
        lv = lv[1:]
    p = prefix or c
    v = category(c)
    return df.select("*", *[F.when(v == lit, 1).otherwise(0).alias(f"{p}_{lit}") for lit in lv])


def _stack(df: DataFrame, cats: Sequence[str], keep: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), category(c).alias("level")) for c in cats])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.col", "_p.level")


def is_binary_target(df: DataFrame, y: str) -> bool:
    """≤ 2 distinct non-null values, all within {0, 1}."""
    r = df.agg(F.count_distinct(F.col(y)).alias("k"), F.min(y).alias("lo"), F.max(y).alias("hi")).first()
    return r["k"] <= 2 and (r["lo"] is None or (r["lo"] in (0, 1) and r["hi"] in (0, 1)))


def target_stats(df: DataFrame, cats: Sequence[str], y: str, fold: str = "fold") -> DataFrame:
    """Per (col, level, fold): Σy and count of non-null y — one pass for all columns."""
    long = _stack(df.where(F.col(y).isNotNull()), cats, [fold, y])
    return long.groupBy("col", "level", fold).agg(F.sum(F.col(y).cast("double")).alias("sy"),
                                                  F.count(F.lit(1)).alias("n"))


def te_fold_table(stats: DataFrame, gm: Column, smoothing: float = TE_SMOOTHING,
                  fold: str = "fold", folds: Sequence[int] | None = None) -> DataFrame:
    """Smoothed encoding of each level for each fold from the *other* folds:
    (Σy_tr + gm·s) / (n_tr + s); NULL where the level is absent in training."""
    tot = stats.groupBy("col", "level").agg(F.sum("sy").alias("tot_sy"), F.sum("n").alias("tot_n"))
    fold_ids = F.array(*[F.lit(int(f)) for f in folds]) if folds is not None else None
    grid = tot.select("col", "level", "tot_sy", "tot_n", F.explode(fold_ids).alias(fold))
    j = grid.join(stats, ["col", "level", fold], "left")
    n_tr = F.col("tot_n") - F.coalesce(F.col("n"), F.lit(0))
    sy_tr = F.col("tot_sy") - F.coalesce(F.col("sy"), F.lit(0.0))
    te = F.when(n_tr > 0, (sy_tr + gm * smoothing) / (n_tr + smoothing))
    return j.select("col", "level", fold, te.alias("te"))


def stratified_target_folds(df: DataFrame, y: str, k: int, seed: int, out: str = "fold") -> DataFrame:
    """Folds stratified on y (binary) or on y > median(y): md5 order within
    each stratum, dealt round-robin (bucketed global rank, no one-task window)."""
    from causeway.operators.folds import assign_folds_stratified
    from causeway.operators.order import exact_quantiles

    if is_binary_target(df, y):
        strat = df.withColumn("_strat", F.col(y).cast("int"))
    else:
        med = exact_quantiles(df, y, [0.5]).first()["q"]
        strat = df.withColumn("_strat", (F.col(y) > F.lit(med)).cast("int"))
    return assign_folds_stratified(strat, k, seed, "_strat", fold_col=out).drop("_strat")


def _target_value(df: DataFrame, y: str) -> Column:
    return (F.col(y) == 1).cast("double") if is_binary_target(df, y) else F.col(y).cast("double")


def global_mean(df: DataFrame, y: str, value: Column | None = None) -> float:
    """Mean of the target over the rows that have one (0 without any)."""
    value = _target_value(df, y) if value is None else value
    return float(df.agg(F.avg(F.when(F.col(y).isNotNull(), value))).first()[0] or 0.0)


def _look_up(df: DataFrame, table: DataFrame, c: str, value: Column, out: str) -> DataFrame:
    """Adds ``out``: ``value`` of the row of ``table`` (col, level, …) that
    holds the level of ``c``; NULL for levels it doesn't hold."""
    tab = table.where(F.col("col") == c).select(F.col("level").alias("_lvl"), value.alias(out))
    return join_small(df.withColumn("_lvl", category(c)), tab, "_lvl", "left").drop("_lvl")


def target_encode_apply(df: DataFrame, cats: Sequence[str], te_map: DataFrame, gm: float) -> DataFrame:
    """``<c>__te`` from a fitted map; levels the map doesn't hold get the global mean."""
    for c in cats:
        df = _look_up(df, te_map, c, F.col("te"), f"{c}__te").withColumn(
            f"{c}__te", F.coalesce(F.col(f"{c}__te"), F.lit(gm)))
    return df


def target_encode_oof(df: DataFrame, cats: Sequence[str], y: str, k: int, fold: str = "fold",
                      smoothing: float = TE_SMOOTHING) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold target encoding ``<c>__te`` plus the inference map.

    The global mean gm is over all rows with y (held-out included); for a
    binary target it is the share of y == 1.  Unseen levels get gm.  The map
    is the plain mean over folds of the per-fold encodings, skipping folds in
    which the level was absent.
    """
    yv = _target_value(df, y)
    gm = F.lit(global_mean(df, y, yv))
    work = df.withColumn("_yv", F.when(F.col(y).isNotNull(), yv))
    stats = target_stats(work, cats, "_yv", fold)
    per_fold = te_fold_table(stats, gm, smoothing, fold, list(range(k)))
    per_fold = per_fold.persist()
    out = df
    for c in cats:
        tab = per_fold.where(F.col("col") == c).select(
            F.col("level").alias("_lvl"), fold, F.col("te").alias(f"{c}__te"))
        out = join_small(out.withColumn("_lvl", category(c)), tab, ["_lvl", fold], "left").drop("_lvl")
        out = out.withColumn(f"{c}__te", F.coalesce(F.col(f"{c}__te"), gm))
    te_map = per_fold.where(F.col("te").isNotNull()).groupBy("col", "level").agg(
        F.avg("te").alias("te"), F.count(F.lit(1)).alias("n_folds"))
    return out, te_map


def count_table(df: DataFrame, cats: Sequence[str]) -> tuple[DataFrame, int]:
    """(col, level, cnt) of every level, missing counted as one, and the row count."""
    return _stack(df, cats, []).groupBy("col", "level").agg(F.count(F.lit(1)).alias("cnt")), df.count()


def count_frequency(df: DataFrame, cats: Sequence[str], table: DataFrame | None = None,
                    rows: int | None = None) -> DataFrame:
    """``<c>__count`` and ``<c>__freq`` = count / N from a fitted count_table or,
    without one, from ``df`` itself; levels it doesn't hold get 0."""
    if table is None:
        table, rows = count_table(df, cats)
        table = table.persist()
    for c in cats:
        df = _look_up(df, table, c, F.col("cnt").cast("double"), f"{c}__count")
        df = df.withColumn(f"{c}__count", F.coalesce(F.col(f"{c}__count"), F.lit(0.0))) \
               .withColumn(f"{c}__freq", F.col(f"{c}__count") / F.lit(max(rows, 1)))
    return df


def woe_table(df: DataFrame, cats: Sequence[str], y: str) -> DataFrame:
    """Weight of evidence per level: ln((n1/N1) / (n0/N0)) for a 0/1 target;
    NULL for a level missing from either class."""
    long = _stack(df.where(F.col(y).isNotNull()), cats, [y])
    per = long.groupBy("col", "level").agg(F.count(F.when(F.col(y) == 1, 1)).alias("n1"),
                                           F.count(F.when(F.col(y) == 0, 1)).alias("n0"))
    tot = df.agg(F.count(F.when(F.col(y) == 1, 1)).alias("tot1"),
                 F.count(F.when(F.col(y) == 0, 1)).alias("tot0"))
    per = attach(per, tot, [])
    ok = (F.col("n1") > 0) & (F.col("n0") > 0)
    woe = F.when(ok, F.log((F.col("n1") / F.col("tot1")) / (F.col("n0") / F.col("tot0"))))
    return per.select("col", "level", "n1", "n0", woe.alias("woe"))


def woe_encode(df: DataFrame, cats: Sequence[str], y: str | None = None,
               table: DataFrame | None = None) -> DataFrame:
    """Row-level ``<c>__woe`` from a fitted :func:`woe_table` or from ``df`` and ``y``."""
    table = woe_table(df, cats, y).persist() if table is None else table
    for c in cats:
        df = _look_up(df, table, c, F.col("woe"), f"{c}__woe")
    return df
