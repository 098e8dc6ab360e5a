"""Global order statistics without a single-partition window.

A window with no ``partitionBy`` pulls every row into one task.  Here each
group gets cut points of its own, and rows are numbered bucket by bucket:

1. ``PER_BUCKET`` of ``BUCKET_ROWS`` rows are sampled by the hash of the tie-break
   column — the same rows at every retry — and every ``PER_BUCKET``-th of a
   group's sorted sample is a cut point (every so many more that there are at
   most ``MAX_CUTS``).  The splitter table has one row per group, and its size
   follows the input; a group's sample, a 6,000th of its rows, is sorted in one
   task;
2. rows find their bucket by binary search among their group's cut points.  A
   cut point is a (missing, key, tie-break) triple and rows are compared as such
   triples, so a value that a third of all rows share, or all NULL keys, are
   spread by the tie-break like any other range of rows, whatever its type;
3. per-bucket counts (and sums) form a small table whose running totals are
   the bucket offsets; it is joined back (null-safe on the group keys).  Cut
   points and offsets are broadcast: there is one per ``BUCKET_ROWS`` rows of the
   input, so no hot group is brought into one task to meet them;
4. ``row_number`` / running ``sum`` over ``partitionBy(group, bucket)``.

The plan is lazy (no job runs before the result is asked for), one for every
size, exact whatever the cut points are, and deterministic under task retry
(no partition ids, no random numbers).  Quantiles work on (value, count)
pairs, so a repeated value is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.joins import join_null_safe

#: Rows a bucket is to hold (``causeway.order.rows`` in the session changes it).
BUCKET_ROWS = 100_000
#: Most buckets of one group: bounds the cut points a group carries (beyond it,
#: buckets grow with the group).
MAX_CUTS = 8192
#: Sampled rows per bucket.
PER_BUCKET = 16

_STEPS = [1 << i for i in range(MAX_CUTS.bit_length() - 1, -1, -1)]


def _steps(cuts: Column) -> Column:
    """Strides of a binary search among the cut points: the powers of two up to their number."""
    return F.filter(F.array(*[F.lit(s) for s in _STEPS]), lambda s: s <= F.size(cuts))


def _bucket(cuts: Column, row: Column, steps: Column | None = None) -> Column:
    """Number of cut points at or below the row (binary search)."""
    def step(at: Column, size: Column) -> Column:
        there = F.get(cuts, at + size - 1)
        return F.when((at + size <= F.size(cuts)) & (there <= row), at + size).otherwise(at)

    found = F.aggregate(_steps(cuts) if steps is None else steps, F.lit(0), step)
    return F.when(F.size(cuts) > 0, found).otherwise(F.lit(0))


def splitters(df: DataFrame, row: Column, tie: str, group: Sequence[str], bucket_rows: int) -> DataFrame:
    """``group…, _cuts, _steps``: the sorted cut points of every group and the
    strides of a search among them; a group without a sampled row is not in the table (one bucket is enough)."""
    group = list(group)
    share = min(1.0, PER_BUCKET / bucket_rows)
    drawn = F.pmod(F.xxhash64(tie), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))
    whole = Window.partitionBy(*group) if group else Window.partitionBy()
    sample = df.where(drawn).select(*group, row.alias("_row")).select(
        "*", F.count(F.lit(1)).over(whole).alias("_m"), F.row_number().over(whole.orderBy("_row")).alias("_i"))
    every = F.greatest(F.lit(PER_BUCKET), F.ceil(F.col("_m") / F.lit(MAX_CUTS)))
    return (sample.where(F.col("_i") % every == 0).groupBy(*group)
            .agg(F.array_sort(F.collect_list("_row")).alias("_cuts")).withColumn("_steps", _steps(F.col("_cuts"))))


def ordered(df: DataFrame, key: str, ascending: bool = True, tie: str = "id",
            group: Sequence[str] = (), sums: Sequence[str] = (), pos_col: str = "pos",
            bucket_rows: int | None = None) -> DataFrame:
    """Add the 1-based position of each row within ``group`` when sorted by
    ``key`` (NULLS LAST) then ``tie`` ascending (NULLS FIRST), plus inclusive
    running sums ``cum_<s>`` for every column in ``sums``.

    ``tie`` may be of any ordered type; NULL group keys are a group.
    """
    group = list(group)
    bucket_rows = bucket_rows or int(df.sparkSession.conf.get("causeway.order.rows", str(BUCKET_ROWS)))
    k = F.col(key).cast("double") + F.lit(0.0)  # −0.0 and 0.0 sort as one value
    work = df.withColumn("_k", k if ascending else -k)
    row = F.struct(F.col("_k").isNull().alias("m"), F.coalesce("_k", F.lit(0.0)).alias("k"), F.col(tie).alias("t"))
    cuts = splitters(work.select(*dict.fromkeys([*group, tie]), "_k"), row, tie, group, bucket_rows)
    none = F.array().cast(dict(cuts.dtypes)["_cuts"])
    if group:
        # a cut point per bucket_rows rows, no row for a group under that: far smaller than the input
        work = join_null_safe(work, cuts, group, how="left", broadcast=True)
    else:
        work = work.crossJoin(F.broadcast(cuts))  # one row
    work = work.withColumn("_b", _bucket(F.coalesce("_cuts", none), row, F.coalesce("_steps", F.array().cast("array<int>")))) \
               .drop("_cuts", "_steps")

    counts = work.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"),
                                            *[F.sum(s).alias(f"_sum_{s}") for s in sums])
    prior = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *group, "_b",
        F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_sum_{s}").over(prior), F.lit(0.0)).alias(f"_soff_{s}") for s in sums],
    )
    # nothing lies before a first bucket; the others are as many as the cut points
    work = join_null_safe(work, offsets.where(F.col("_b") > 0), group, ["_b"], how="left", broadcast=True)
    work = work.withColumns({"_off": F.coalesce("_off", F.lit(0)),
                             **{f"_soff_{s}": F.coalesce(f"_soff_{s}", F.lit(0.0)) for s in sums}})
    # a number of its own: runtime coalescing goes by bytes and would leave the sort to a task or two
    work = work.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group, "_b")

    w = Window.partitionBy(*group, "_b").orderBy(F.col("_k").asc_nulls_last(), F.col(tie).asc())
    w_run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = work.withColumn(pos_col, (F.col("_off") + F.row_number().over(w)).cast("bigint"))
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"_soff_{s}") + F.sum(s).over(w_run))
    return out.drop("_k", "_b", "_off", *[f"_soff_{s}" for s in sums])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    group: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """Linear-interpolation quantiles (numpy 'linear', SQL quantile_cont) per
    group, exact.  Returns ``group…, p, q``; a NULL group key is a group.

    Values are counted first (map-side), so ties cost nothing; ``tie`` is not
    needed and only kept for callers that name one.
    """
    return weighted_quantiles(df.withColumn("_c", F.lit(1)), value, "_c", probs, group)


def weighted_quantiles(df: DataFrame, value: str, count: str, probs: Sequence[float],
                       group: Sequence[str] = ()) -> DataFrame:
    """``exact_quantiles`` of values that stand for ``count`` rows each."""
    group = list(group)
    pairs = (df.where(F.col(value).isNotNull()).select(*group, (F.col(value) + F.lit(0)).alias(value), F.col(count).alias("_c"))
             .groupBy(*group, value).agg(F.sum("_c").alias("_c")))
    run = ordered(pairs, value, True, value, group, sums=["_c"], pos_col="_p")
    n = pairs.groupBy(*group).agg(F.sum("_c").alias("_cnt"))
    sized = join_null_safe(run, n, group) if group else run.crossJoin(F.broadcast(n))  # one row
    ranked = sized.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    h = F.col("p") * (F.col("_cnt") - 1)
    first, last = F.col("cum__c") - F.col("_c") + 1, F.col("cum__c")
    lo, hi = F.floor(h) + 1, F.ceil(h) + 1
    is_lo, is_hi = lo.between(first, last), hi.between(first, last)
    return (ranked.where(is_lo | is_hi).groupBy(*group, "p").agg(
        F.max(F.when(is_lo, F.col(value))).alias("_vlo"),
        F.max(F.when(is_hi, F.col(value))).alias("_vhi"),
        F.first(h - F.floor(h)).alias("_frac"))
        .select(*group, "p", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias("q")))
