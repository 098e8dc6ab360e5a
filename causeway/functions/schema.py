"""Schema-level helpers (driver metadata only, no data touched)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


def category_columns(df: DataFrame, only: Sequence[str] | None = None) -> list[str]:
    """String/boolean columns, optionally intersected with ``only``."""
    cats = [f.name for f in df.schema.fields if isinstance(f.dataType, (StringType, BooleanType))]
    return [c for c in cats if only is None or c in only]


def existing_columns(df: DataFrame, wanted: Sequence[str],
                     substitutes: Mapping[str, str] | None = None) -> list[str]:
    """Keep the wanted columns that exist, replacing absent ones by a substitute."""
    have = set(df.columns)
    out = []
    for c in wanted:
        if c in have:
            out.append(c)
        elif substitutes and substitutes.get(c) in have:
            out.append(substitutes[c])
    return out


def derived_outcome(df: DataFrame, after: str, before: str, out: str = "y") -> DataFrame:
    """``out = after − before``; both columns must exist."""
    missing = [c for c in (after, before) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns for the derived outcome: {missing}")
    return df.withColumn(out, F.col(after).cast("double") - F.col(before).cast("double"))


def guard_leakage(features: Sequence[str], outcomes: Sequence[str]) -> None:
    """Refuse feature lists that contain an outcome column."""
    bad = sorted(set(features) & set(outcomes))
    if bad:
        raise ValueError(f"outcome columns used as features: {bad}")
