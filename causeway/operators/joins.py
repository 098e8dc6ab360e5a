"""Joins against derived small tables, and the caches they need.

A side is broadcast only behind a size check: either a bound that holds by
construction (a fixed dimension, or folds × cells of a statistics table) or
a count of the rows and bytes of an already aggregated table.  Above the limit
the join falls back to a shuffle join and AQE may still re-plan it at runtime.

Joins on key names are null-safe: a NULL key is a group like any other.

Derived tables that a plan reads more than once are cached with :func:`keep`,
or written to the shared folder with :func:`settle` where a plan would otherwise
hold many copies of a long lineage (planning time grows with the copies, and a
lost executor would start all over).  Plans are lazy, so an operator can't know
when its last reader is done; who runs the action does.  Inside ``with
caches():`` every table kept or settled is released at the end of the block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import broadcast_limit_bytes, broadcast_limit_rows, ensure_checkpoint_dir

_kept: ContextVar[list[DataFrame | str] | None] = ContextVar("kept", default=None)


def keep(df: DataFrame) -> DataFrame:
    """Cache ``df`` (memory, then disk) until the enclosing ``caches()`` ends."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    scope = _kept.get()
    if scope is not None:
        scope.append(df)
    return df


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: a plan of one
    scan, with column pruning, that survives lost executors."""
    folder = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{folder}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    scope = _kept.get()
    if scope is not None:
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def caches(spark: SparkSession) -> Iterator[None]:
    """Releases what was kept or settled inside the block.  Run the actions inside it."""
    token = _kept.set([])
    try:
        yield
    finally:
        for item in reversed(_kept.get() or []):
            if isinstance(item, str):
                path = spark._jvm.org.apache.hadoop.fs.Path(item)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            else:
                item.unpersist()
        _kept.reset(token)


def fits_broadcast(small: DataFrame) -> bool:
    """Whether a derived table is under the row and byte limits (one aggregate)."""
    spark = small.sparkSession
    wide = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in small.dtypes if kind in ("string", "binary")]
    text = sum(wide, F.lit(0)) if wide else F.lit(0)
    rows, chars = small.agg(F.count(F.lit(1)), text).first()
    return (rows <= broadcast_limit_rows(spark)
            and rows * 16 * len(small.columns) + chars <= broadcast_limit_bytes(spark))


def join_null_safe(big: DataFrame, small: DataFrame, group: Sequence[str], keys: Sequence[str] = (),
                   how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Equi-join on ``group`` (NULL equals NULL) and ``keys`` (never NULL)."""
    right = small.select(*[F.col(c).alias(f"_j_{c}") if c in group or c in keys else F.col(c)
                           for c in small.columns])
    on = [big[c].eqNullSafe(right[f"_j_{c}"]) for c in group] + [big[c] == right[f"_j_{c}"] for c in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return big.join(F.broadcast(right) if broadcast else right, cond, how).drop(
        *[f"_j_{c}" for c in [*group, *keys]])


def join_small(big: DataFrame, small: DataFrame, on: Column | str | list, how: str = "inner",
               max_rows: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """Join ``big`` with ``small``; broadcast ``small`` if its size is bounded
    (``max_rows`` is a bound that holds by construction).

    Without a bound the size of ``small`` is measured.  If ``big`` is narrow
    steps over a kept table (``source``), that happens when the plan runs: Spark
    fills both caches first and broadcasts what is below its threshold then, so
    no job runs before the result is asked for.  Otherwise ``big`` would be
    shuffled before that choice, and ``small`` is counted beforehand."""
    if max_rows is not None:
        fits = max_rows <= broadcast_limit_rows(big.sparkSession)
    else:
        small = keep(small)
        lazy = source is not None and source.storageLevel.useMemory
        fits = not lazy and fits_broadcast(small)
    if isinstance(on, Column):
        return big.join(F.broadcast(small) if fits else small, on, how)
    return join_null_safe(big, small, [on] if isinstance(on, str) else list(on), how=how, broadcast=fits)


def attach(df: DataFrame, totals: DataFrame, group: list[str]) -> DataFrame:
    """Add per-group totals (one row per group) to every row of ``df``.

    Grouped: an equi-join on the group keys (NULL is a group), planned by size at
    run time.  Ungrouped: ``totals`` is one row at most, broadcast; without it the
    columns are NULL.
    """
    if group:
        return join_null_safe(df, totals, group)
    return df.join(F.broadcast(totals), how="left")
