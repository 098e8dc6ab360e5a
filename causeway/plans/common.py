"""Shared building blocks of the named queries: panels with folds and
cross-fitted nuisances for the customer and order campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.config import EffectConfig
from causeway.operators.folds import assign_folds
from causeway.operators.joins import keep
from causeway.operators.nuisance.strata import strata_nuisance
from causeway.sources.panels import customer_cell, order_cell, panel_customer, panel_orders

DEFAULT = EffectConfig()
MONEY_SCALE = 2  # outcomes are amounts in cents precision


def customer_folds(spark: SparkSession, sf_dir: str, cfg: EffectConfig = DEFAULT) -> DataFrame:
    # Reused by the statistics pass and the row-level pass: persisted.
    return keep(assign_folds(panel_customer(spark, sf_dir), cfg.n_splits, cfg.seed))


def customer_nuisance(spark: SparkSession, sf_dir: str, cfg: EffectConfig = DEFAULT,
                      y: str = "y") -> DataFrame:
    panel = customer_folds(spark, sf_dir, cfg)
    if y != "y":
        panel = panel.withColumnRenamed("y", "y_main").withColumnRenamed(y, "y")
    # The nuisance table is the pivot every estimate and diagnostic reads:
    # persisted once (identical plans share the cached data).
    return keep(strata_nuisance(panel, customer_cell(), cfg, y_scale=MONEY_SCALE))


def order_nuisance(spark: SparkSession, sf_dir: str, cfg: EffectConfig = DEFAULT) -> DataFrame:
    panel = keep(assign_folds(panel_orders(spark, sf_dir), cfg.n_splits, cfg.seed))
    return keep(strata_nuisance(panel, order_cell(), cfg, y_scale=MONEY_SCALE))
