"""Uplift-ranking metrics: gain curves, AUUC areas, nAUUC, policy value at k,
Spearman correlation — all from one bucketed global rank plus aggregates.

Rows are ordered by score descending, NULLS LAST, ties by ``id``.  The
trapezoid area of the cumulative gain over x = 1/n … 1 has a closed form
in the rank r of each row:

    area = ( Σ_r (n − r + 1)·ψ_r − (ψ_1 + Σ ψ) / 2 ) / n

so a rank column and one aggregate replace the cumulative sum.  ``centered``
subtracts the mean ψ first (the ranking-quality variant); the tuners use
the uncentered one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.joins import join_null_safe
from causeway.operators.order import ordered


def rank_desc(df: DataFrame, score: str, group: Sequence[str] = (), pos: str = "pos",
              sums: Sequence[str] = ()) -> DataFrame:
    return ordered(df, score, ascending=False, tie="id", group=group, sums=sums, pos_col=pos)


def auuc_areas(df: DataFrame, scores: Sequence[str], psi: str = "psi", group: Sequence[str] = (),
               centered: bool = True) -> DataFrame:
    """``group…, n, area_<score>…`` — trapezoid areas of cumulative ψ, one per
    score ordering.  All orderings are ranked in one plan: every row once per
    score, as (score name, value) in a group of its own."""
    group, scores = list(group), list(scores)
    rows = df.where(F.col(psi).isNotNull()).select(
        *group, "id", F.col(psi).alias("_v"),
        F.posexplode(F.array(*[F.col(s).cast("double") for s in scores])).alias("_o", "_score"))
    ranked = ordered(rows, "_score", ascending=False, tie="id", group=[*group, "_o"], pos_col="_r")
    sums = ranked.groupBy(*group, "_o").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_v").alias("_m"), F.sum("_v").alias("_sv"),
        F.sum(F.col("_r") * F.col("_v")).alias("_srv"), F.max(F.when(F.col("_r") == 1, F.col("_v"))).alias("_v1"))
    # Σ (n − r + 1)·(ψ_r − m), the ranks' own sum taken out: Σ r = n (n + 1) / 2
    n, m = F.col("n"), F.col("_m") if centered else F.lit(0.0)
    area = ((n + 1) * (F.col("_sv") - n * m / 2.0) - F.col("_srv")
            - (F.col("_v1") + F.col("_sv") - (n + 1) * m) / 2.0) / n
    return sums.groupBy(*group).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.max(F.when(F.col("_o") == i, area)).alias(f"area_{s}") for i, s in enumerate(scores)])


def auuc_area(df: DataFrame, score: str, psi: str = "psi", group: Sequence[str] = (),
              centered: bool = True) -> DataFrame:
    """``group…, n, area`` — trapezoid area of cumulative ψ ordered by score."""
    a = auuc_areas(df, [score], psi, group, centered)
    return a.withColumnRenamed(f"area_{score}", "area")


def nauuc(df: DataFrame, score: str = "tau", psi: str = "psi", group: Sequence[str] = (),
          centered: bool = True, on_zero: str = "null") -> DataFrame:
    """Normalised AUUC: clip(area(score) / area(ψ), 0, 1).

    ``on_zero='null'`` gives NULL when |oracle area| ≤ 1e-12 (estimator
    report); ``'zero'`` gives 0 (light tester).  Uncentered areas follow the
    tuner rule: an oracle area ≤ 0 gives 0.
    """
    group = list(group)
    if score == psi:
        a = auuc_areas(df, [psi], psi, group, centered)
        j = a.select(*group, "n", F.col(f"area_{psi}").alias("area_model"),
                     F.col(f"area_{psi}").alias("area_oracle"))
    else:
        a = auuc_areas(df, [score, psi], psi, group, centered)
        j = a.select(*group, "n", F.col(f"area_{score}").alias("area_model"),
                     F.col(f"area_{psi}").alias("area_oracle"))
    ratio = F.least(F.greatest(F.col("area_model") / F.col("area_oracle"), F.lit(0.0)), F.lit(1.0))
    if centered:
        degenerate = F.col("area_oracle").isNull() | (F.abs(F.col("area_oracle")) <= 1e-12)
        fallback = F.lit(None).cast("double") if on_zero == "null" else F.lit(0.0)
    else:
        degenerate = F.col("area_oracle").isNull() | (F.col("area_oracle") <= 0)
        fallback = F.lit(0.0)
    return j.select(*group, "n", "area_model", "area_oracle",
                    F.when(degenerate, fallback).otherwise(ratio).alias("nauuc"))


def policy_table(df: DataFrame, scores: Sequence[str], psi: str = "psi", ks: Sequence[float] = (0.1, 0.2, 0.3),
                 group: Sequence[str] = ()) -> DataFrame:
    """Σψ over the top max(1, floor(n·k)) rows by each score, for every k and
    score in one plan: ``group…, score, k_pct, m, policy_value`` (k_pct =
    round(100·k))."""
    group, scores = list(group), list(scores)
    rows = df.where(F.col(psi).isNotNull()).select(
        *group, "id", F.col(psi).alias("_v"),
        F.posexplode(F.array(*[F.col(s).cast("double") for s in scores])).alias("_o", "_score"))
    keys = [*group, "_o"]
    ranked = ordered(rows, "_score", ascending=False, tie="id", group=keys, pos_col="_r")
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cut = F.explode(F.array(*[F.struct(
        F.lit(int(round(100 * k))).alias("k_pct"),
        F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(k)))).cast("bigint").alias("m")) for k in ks]))
    tops = n.select(*keys, cut.alias("_k")).groupBy(*keys).agg(F.collect_list("_k").alias("_ks"))  # one list of len(ks) per group
    hit = join_null_safe(ranked, tops, keys).withColumn("_k", F.explode("_ks"))
    out = hit.groupBy(*keys, F.col("_k.k_pct").alias("k_pct"), F.col("_k.m").alias("m")).agg(
        F.sum(F.when(F.col("_r") <= F.col("_k.m"), F.col("_v"))).alias("policy_value"))
    return out.select(*group, F.get(F.array(*[F.lit(s) for s in scores]), F.col("_o")).alias("score"), "k_pct", "m", "policy_value")


def policy_values(df: DataFrame, score: str = "tau", psi: str = "psi",
                  ks: Sequence[float] = (0.1, 0.2, 0.3), group: Sequence[str] = ()) -> DataFrame:
    """``group…, k_pct, m, policy_value`` of one score."""
    return policy_table(df, [score], psi, ks, group).drop("score")


def gain_curve(df: DataFrame, score: str = "tau", psi: str = "psi", points: int = 100,
               group: Sequence[str] = ()) -> DataFrame:
    """Cumulative ψ of the top max(1, floor(n·q/points)) rows, q = 1..points."""
    group = list(group)
    base = df.where(F.col(psi).isNotNull()).select(*group, "id", score, psi)
    n = base.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = rank_desc(base, score, group, pos="_r", sums=[psi])
    grid = n.select(*group, "_n", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("q")) \
        .withColumn("_r", F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("q") / F.lit(float(points))))
                    .cast("bigint"))
    hit = join_null_safe(ranked.select(*group, "_r", F.col(f"cum_{psi}").alias("gain")), grid, group, ["_r"])
    return hit.select(*group, "q", F.col("_r").alias("m"), (F.col("_r") / F.col("_n")).alias("coverage"),
                      "gain")


def average_ranks(df: DataFrame, value: str, group: Sequence[str] = (), out: str = "rank") -> DataFrame:
    """Ascending ranks with ties sharing their average rank (NULLs dropped)."""
    group = list(group)
    distinct = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("_c"))
    run = ordered(distinct, value, True, value, group, sums=["_c"], pos_col="_p")
    run = run.select(*group, value, (F.col("cum__c") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(out))
    return join_null_safe(df, run, group, [value])


def spearman(df: DataFrame, a: str, b: str, group: Sequence[str] = ()) -> DataFrame:
    """Spearman ρ with average ranks for ties; rows with a NULL are omitted."""
    group = list(group)
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*group, "id", a, b)
    ra = average_ranks(both, a, group, "_ra")
    rb = average_ranks(both.select(*group, "id", b), b, group, "_rb").select(*group, "id", "_rb")
    j = join_null_safe(ra, rb, group, ["id"])
    return j.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("spearman"))


def uplift_curve(df: DataFrame, score: str = "tau", psi: str = "psi",
                 percents: Sequence[int] = tuple(range(5, 101, 5)), group: Sequence[str] = ()) -> DataFrame:
    """Mean ψ among the top q % by score (top max(1, floor(n·q/100)) rows)."""
    group = list(group)
    base = df.where(F.col(psi).isNotNull()).select(*group, "id", score, psi)
    n = base.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = rank_desc(base, score, group, pos="_r", sums=[psi])
    grid = n.select(*group, "_n", F.explode(F.array(*[F.lit(int(q)) for q in percents])).alias("q")) \
        .withColumn("_r", F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("q") / F.lit(100.0))).cast("bigint"))
    hit = join_null_safe(ranked.select(*group, "_r", F.col(f"cum_{psi}").alias("_cum")), grid, group, ["_r"])
    return hit.select(*group, "q", F.col("_r").alias("m"), (F.col("_cum") / F.col("_r")).alias("mean_uplift"))


def qini_curve(df: DataFrame, score: str = "tau", y: str = "y", points: int = 100,
               group: Sequence[str] = ()) -> DataFrame:
    """Qini curve: among the top m rows by score, treated outcome total minus
    control outcome total scaled by N1(m)/N0(m) (NULL while no control)."""
    group = list(group)
    base = df.where(F.col(y).isNotNull()).select(
        *group, "id", score, (F.col("t") * F.col(y)).alias("_y1"), ((1 - F.col("t")) * F.col(y)).alias("_y0"),
        F.col("t").cast("long").alias("_t1"), (1 - F.col("t")).cast("long").alias("_t0"))
    n = base.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = rank_desc(base, score, group, pos="_r", sums=["_y1", "_y0", "_t1", "_t0"])
    grid = n.select(*group, "_n", F.explode(F.sequence(F.lit(1), F.lit(points))).alias("q")) \
        .withColumn("_r", F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("q") / F.lit(float(points))))
                    .cast("bigint"))
    hit = join_null_safe(ranked.select(*group, "_r", "cum__y1", "cum__y0", "cum__t1", "cum__t0"), grid, group, ["_r"])
    qini = F.col("cum__y1") - F.col("cum__y0") * F.col("cum__t1") / F.when(F.col("cum__t0") > 0, F.col("cum__t0"))
    return hit.select(*group, "q", F.col("_r").alias("m"), qini.alias("qini"))
