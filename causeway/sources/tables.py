"""Reading the input tables.

Each table is one parquet dataset; callers select the columns they need
right away so the scan's ReadSchema is pruned, and put row filters on the
returned DataFrame so Catalyst pushes them into the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Upper bounds of the fixed TPC-H dimensions (they do not grow with scale),
# which makes them safe broadcast sides.
FIXED_DIMENSION_ROWS = {"region": 5, "nation": 25}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Parquet scan of one table."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def ts(day: str) -> Column:
    """TIMESTAMP_NTZ literal (parquet timestamps without zone load as NTZ)."""
    return F.expr(f"TIMESTAMP_NTZ '{day} 00:00:00'")
