"""Group statistics joined back to the rows (``grp_{k1__k2}__{num}__{f}``).

For each key set, every numeric column is aggregated in one grouped pass
(mean, std with ddof 1, count of non-null values, distinct count); medians
come from the exact bucketed quantile operator over the stacked
``(column, value)`` rows, so a hot key (a third of all rows) never builds
one giant in-memory value map.  NULL keys form a group of their own and the
join back is null-safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.joins import join_small, keep
from causeway.operators.order import exact_quantiles

AGG_FUNCS = ("mean", "median", "std", "count", "nunique")


def _median_long(df: DataFrame, keys: list[str], nums: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("_num"), F.col(n).cast("double").alias("_v")) for n in nums])
    long = df.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p._num", "_p._v")
    # Key columns may hold NULL: encode them as a sentinel-free struct key.
    long = long.withColumn("_key", F.to_json(F.struct(*[F.col(k) for k in keys])))
    q = exact_quantiles(long.select("_key", "_num", "_v"), "_v", [0.5], ["_key", "_num"])
    return q.select("_key", "_num", F.col("q").alias("median"))


def group_tables(df: DataFrame, key_sets: Sequence[Sequence[str]], nums: Sequence[str],
                 funcs: Sequence[str] = AGG_FUNCS) -> list[tuple[list[str], DataFrame]]:
    """(keys, statistics table) per key set; the keys are named ``_k_<key>``."""
    tables = []
    # one narrow copy serves the statistics and medians of every key set
    df = keep(df.select(*dict.fromkeys([*[k for keys in key_sets for k in keys], *nums])))
    for keys in map(list, key_sets):
        kname = "__".join(keys)
        aggs = []
        for n in nums:
            x = F.col(n).cast("double")
            if "mean" in funcs:
                aggs.append(F.avg(x).alias(f"grp_{kname}__{n}__mean"))
            if "std" in funcs:
                aggs.append(F.stddev_samp(x).alias(f"grp_{kname}__{n}__std"))
            if "count" in funcs:
                aggs.append(F.count(x).cast("double").alias(f"grp_{kname}__{n}__count"))
            if "nunique" in funcs:
                aggs.append(F.count_distinct(x).cast("double").alias(f"grp_{kname}__{n}__nunique"))
        stats = df.groupBy(*keys).agg(*aggs)
        if "median" in funcs:
            med = _median_long(df, keys, nums)
            wide = med.groupBy("_key").pivot("_num", list(nums)).agg(F.first("median"))
            wide = wide.select("_key", *[F.col(n).alias(f"grp_{kname}__{n}__median") for n in nums])
            stats = stats.withColumn("_key", F.to_json(F.struct(*[F.col(k) for k in keys])))
            stats = stats.join(wide, "_key", "left").drop("_key")
        tables.append((keys, stats.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                                          *[c for c in stats.columns if c not in keys])))
    return tables


def group_apply(df: DataFrame, tables: Sequence[tuple[list[str], DataFrame]]) -> DataFrame:
    """Joins fitted statistics back; a group they don't hold gets NULLs."""
    for keys, stats in tables:
        cond = F.lit(True)
        for k in keys:
            cond = cond & df[k].eqNullSafe(stats[f"_k_{k}"])
        df = join_small(df, stats, cond, "left").drop(*[f"_k_{k}" for k in keys])
    return df


def group_aggregates(df: DataFrame, key_sets: Sequence[Sequence[str]], nums: Sequence[str],
                     funcs: Sequence[str] = AGG_FUNCS) -> DataFrame:
    return group_apply(df, group_tables(df, key_sets, nums, funcs))
