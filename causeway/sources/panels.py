"""Analysis panels ``(id, t, y, y_nc, covariates…)`` built from the raw tables.

A campaign panel is one row per unit.  Treatment, outcome and pre-period
covariates are conditional aggregates over the unit's order log, computed
in a single grouped pass (partial aggregation map-side, one shuffle on the
unit key), then joined to the unit table, whose key partitioning the
aggregate already has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.joins import join_small
from causeway.sources.tables import FIXED_DIMENSION_ROWS, read_table, ts

# The customer-panel campaign definition.
URGENT_PRIORITIES = ("1-URGENT", "2-HIGH")
TREAT_START, TREAT_END = "1998-01-01", "1999-01-01"
OUTCOME_START, OUTCOME_END = "1999-01-01", "2000-01-01"
NC_START, NC_END = "1997-01-01", "1998-01-01"


def _between(c: Column, lo: str, hi: str) -> Column:
    return (c >= ts(lo)) & (c < ts(hi))


def cents(c: Column) -> Column:
    """Money as integer cents, so sums are exact and order-independent."""
    return F.round(c * F.lit(100.0)).cast("bigint")


def from_cents(c: Column) -> Column:
    return c.cast("double") / F.lit(100.0)


def nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")


def panel_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer panel: priority orders in 1998 → spend in 1999.

    Columns: id, t, y, y_nc, before_cnt, before_amt, seg, region, acctbal.
    """
    d = F.col("o_orderdate")
    price = cents(F.col("o_totalprice"))
    orders = (read_table(spark, sf_dir, "orders", "o_custkey", "o_totalprice",
                         "o_orderdate", "o_orderpriority")
              .where(d < ts(OUTCOME_END)))
    per_customer = orders.groupBy("o_custkey").agg(
        F.max(F.when(F.col("o_orderpriority").isin(*URGENT_PRIORITIES)
                     & _between(d, TREAT_START, TREAT_END), 1).otherwise(0)).alias("t_any"),
        F.sum(F.when(_between(d, OUTCOME_START, OUTCOME_END), price)).alias("y_sum"),
        F.sum(F.when(_between(d, NC_START, NC_END), price)).alias("nc_sum"),
        F.count(F.when(d < ts(TREAT_START), 1)).alias("before_n"),
        F.sum(F.when(d < ts(TREAT_START), price)).alias("before_sum"),
    )
    customers = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey",
                           "c_acctbal", "c_mktsegment")
    customers = join_small(customers, nation_region(spark, sf_dir),
                           F.col("c_nationkey") == F.col("n_nationkey"), "inner",
                           max_rows=FIXED_DIMENSION_ROWS["nation"])
    joined = customers.join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(
        F.col("c_custkey").alias("id"),
        F.coalesce(F.col("t_any"), F.lit(0)).cast("int").alias("t"),
        F.coalesce(from_cents(F.col("y_sum")), F.lit(0.0)).alias("y"),
        F.coalesce(from_cents(F.col("nc_sum")), F.lit(0.0)).alias("y_nc"),
        F.coalesce(F.col("before_n"), F.lit(0)).cast("bigint").alias("before_cnt"),
        F.coalesce(from_cents(F.col("before_sum")), F.lit(0.0)).alias("before_amt"),
        F.col("c_mktsegment").alias("seg"),
        F.col("n_regionkey").cast("int").alias("region"),
        F.col("c_acctbal").alias("acctbal"),
    )


def customer_cell() -> Column:
    """Strata of the customer panel: region × (min(before_cnt, 4) div 2)."""
    return (F.col("region") * 3 + F.expr("least(before_cnt, 4) div 2")).cast("int")


def panel_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order panel: priority flag → order value; cells = status × region."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice",
                        "o_orderstatus", "o_orderpriority", "o_orderdate")
    customers = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    customers = join_small(customers, nation_region(spark, sf_dir),
                           F.col("c_nationkey") == F.col("n_nationkey"), "inner",
                           max_rows=FIXED_DIMENSION_ROWS["nation"])
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "inner")
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").isin(*URGENT_PRIORITIES).cast("int").alias("t"),
        F.col("o_totalprice").alias("y"),
        F.col("o_orderstatus").alias("status"),
        F.col("n_regionkey").cast("int").alias("region"),
        F.col("o_orderdate").alias("order_date"),
    )


def order_cell() -> Column:
    """Strata of the order panel: status × region."""
    status_code = (F.when(F.col("status") == "F", 0).when(F.col("status") == "O", 1)
                   .when(F.col("status") == "P", 2).otherwise(3))
    return (status_code * 5 + F.col("region")).cast("int")


def panel_events(spark: SparkSession, sf_dir: str, split_day: str = "2024-01-16") -> DataFrame:
    """User panel from the event log, split at a day.

    t = the user clicked more than they viewed before the split; y = value of
    their purchases after it; covariates are pre-period event counts/values.
    """
    ev = read_table(spark, sf_dir, "events", "user_id", "ts", "event_type", "value")
    before = F.col("ts") < ts(split_day)
    etype = F.col("event_type")
    agg = ev.groupBy("user_id").agg(
        F.count(F.when(before & (etype == "click"), 1)).alias("before_clicks"),
        F.count(F.when(before & (etype == "view"), 1)).alias("before_views"),
        F.sum(F.when(~before & (etype == "purchase"), cents(F.col("value")))).alias("y_cents"),
        F.count(F.when(before, 1)).alias("before_cnt"),
        F.sum(F.when(before, cents(F.col("value")))).alias("before_cents"))
    return agg.select(F.col("user_id").alias("id"),
                      (F.col("before_clicks") > F.col("before_views")).cast("int").alias("t"),
                      F.coalesce(from_cents(F.col("y_cents")), F.lit(0.0)).alias("y"),
                      "before_cnt", F.coalesce(from_cents(F.col("before_cents")), F.lit(0.0)).alias("before_amt"),
                      "before_clicks", "before_views")


def event_cell() -> Column:
    """Strata of the event panel: min(pre-period event count div 25, 3)."""
    return F.least(F.floor(F.col("before_cnt") / 25), F.lit(3)).cast("int")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their quality/toxicity labels (only labelled ones)."""
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    docs = read_table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    return labels.join(docs, "doc_id", "inner").withColumnRenamed("doc_id", "id")
