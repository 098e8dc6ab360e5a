"""Numeric derivatives: log1p, ratios, products, equal-frequency bins, degree-2
polynomial — column expressions built in one ``select``.

Nothing is capped here: every asked pair and every bin becomes a column.  A
caller who wants fewer names the pairs (say, of the best columns by
``reduce.column_scores``) or reduces the result with ``reduce.pca_cap``.
Equal-frequency cut points come from exact quantiles, one pass for all columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.scalar import log1p_pos, safe_div
from causeway.operators.order import exact_quantiles

_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}


def num(c: str) -> Column:
    """Numeric coercion: text that is not a number becomes NULL."""
    return F.expr(f"try_cast(`{c}` AS DOUBLE)")


def log1p_columns(nums: Sequence[str]) -> list[Column]:
    return [log1p_pos(num(c)).alias(f"{c}__log1p") for c in nums]


def counts_of(df: DataFrame, nums: Sequence[str]) -> list[str]:
    """The columns that count something: those of an integral type."""
    kinds = dict(df.dtypes)
    return [c for c in nums if kinds[c] in _INTEGRAL]


def ratio_columns(nums: Sequence[str], per: Sequence[str]) -> list[Column]:
    """Every column of ``nums`` that isn't in ``per``, per unit of each that is."""
    return [safe_div(num(a), num(b)).alias(f"ratio__{a}__per__{b}")
            for b in per for a in nums if a not in set(per)]


def interaction_columns(pairs: Iterable[tuple[str, str]]) -> list[Column]:
    """Product and quotient of each pair."""
    return [col for a, b in pairs
            for col in ((num(a) * num(b)).alias(f"inter__{a}__x__{b}"),
                        safe_div(num(a), num(b)).alias(f"inter__{a}__div__{b}"))]


def numeric_derivatives(df: DataFrame, nums: Sequence[str], log1p: bool = True, ratios: bool = True,
                        interactions: bool = True, per: Sequence[str] | None = None,
                        pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``df`` with the derived columns.  ``per``: the denominators of ratios
    (default: ``counts_of``); ``pairs``: the interactions (default: all)."""
    cols = log1p_columns(nums) if log1p else []
    if ratios:
        cols += ratio_columns(nums, counts_of(df, nums) if per is None else per)
    if interactions:
        cols += interaction_columns(combinations(nums, 2) if pairs is None else pairs)
    return df.select("*", *cols)


def quantile_cuts(df: DataFrame, nums: Sequence[str], q: int = 10) -> DataFrame:
    """Exact interior cut points ``col, p, cut`` (p = i/q) for every column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), num(c).alias("v")) for c in nums])
    long = df.select(F.explode(pairs).alias("_p")).select("_p.col", "_p.v")
    return exact_quantiles(long, "v", [i / q for i in range(1, q)], ["col"]).withColumnRenamed("q", "cut")


def quantile_bins(df: DataFrame, nums: Sequence[str], q: int = 10) -> tuple[DataFrame, dict]:
    """Equal-frequency bins as INT dummies: ``<c>__qbin_0`` … ``<c>__qbin_<q-1>``
    and ``<c>__qbin_nan`` for missing values.

    Bin k holds values in (cut_{k-1}, cut_k] with duplicate cuts merged (the
    bins that are left over are 0 everywhere, so the schema is always the
    same); the cut points are returned, for ``bin_columns`` at transform.
    """
    cuts: dict[str, list[float]] = {c: [] for c in nums}
    # at most (q - 1) numbers per column
    for row in quantile_cuts(df, nums, q).where("cut is not null").orderBy("col", "p").collect():
        known = cuts[row["col"]]
        if not known or row["cut"] > known[-1]:
            known.append(float(row["cut"]))
    return df.select("*", *bin_columns(cuts, q)), cuts


def bin_columns(cuts: dict[str, list[float]], q: int) -> list[Column]:
    """The dummies for given cut points."""
    out = []
    for c, edges in cuts.items():
        at = sum([(num(c) > e).cast("int") for e in edges], F.lit(0))
        out += [F.when(num(c).isNotNull() & (at == k), 1).otherwise(0).alias(f"{c}__qbin_{k}") for k in range(q)]
        out.append(F.when(num(c).isNull(), 1).otherwise(0).alias(f"{c}__qbin_nan"))
    return out


def poly2_columns(nums: Sequence[str]) -> list[Column]:
    """Degree-2 expansion without bias: x_i, then x_i·x_j for i ≤ j (NULL → 0)."""
    xs = [F.coalesce(num(c), F.lit(0.0)) for c in nums]
    cols = [x for x in xs]
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            cols.append(xs[i] * xs[j])
    return [c.alias(f"poly2_{k}") for k, c in enumerate(cols)]
