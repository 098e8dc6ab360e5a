"""Fold membership and permutations, all pure functions of the row id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.hashing import fold_of, md5_int
from causeway.operators.order import ordered


def assign_folds(df: DataFrame, k: int, seed: int, id_col: str = "id",
                 fold_col: str = "fold") -> DataFrame:
    """Shuffled, unstratified K-fold: ``md5(id:seed) mod k``."""
    return df.withColumn(fold_col, fold_of(id_col, k, seed))


def assign_folds_stratified(df: DataFrame, k: int, seed: int, strata: str = "t",
                            id_col: str = "id", fold_col: str = "fold") -> DataFrame:
    """Stratified K-fold: within each stratum, rows ordered by their md5 key
    are dealt round-robin, so every (fold, stratum) count differs by ≤ 1.
    The order is a bucketed global rank, not a one-task window.
    """
    keyed = df.withColumn("_h", md5_int(id_col, seed))
    ranked = ordered(keyed, "_h", True, id_col, [strata], pos_col="_r")
    return ranked.withColumn(fold_col, F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_h", "_r")


def fold_counts(df: DataFrame, fold_col: str = "fold", t_col: str = "t") -> DataFrame:
    """Per (fold, arm) counts — the check that no fold leaves an arm empty."""
    return df.groupBy(fold_col, t_col).agg(F.count(F.lit(1)).alias("n"))
