"""Robustness checks: permutation placebo, negative-control outcome, verdict.

All permutation runs go through one job.  Rows are multiplied by the run
index with ``explode`` (a generator inside the scan stage, never shuffled),
the permuted treatment is an *exact* permutation — within each run the n₁
rows with the smallest ``md5(id:salt:run)`` are treated — and the estimate is
linear in per-run sufficient statistics, so map-side partial aggregation
shrinks the shuffle:

* cell learners: counts and sums per (run, fold, cell, arm), about
  runs × folds × cells rows whatever the row count;
* linear learners: Gram sums per (run, fold) of the treated rows (those of the
  controls are the fold's totals less these, and the totals don't depend on the
  run), solved in the executors for all runs, folds and arms at once; a second
  pass adds up the influence values under the solved coefficients.

The n₁-th smallest key of each run comes from a window: keys are uniform, so
the n₁-th lies within a few √(n₁(1 − n₁/n)) ranks of n₁/n of the key range.
One pass counts the keys below the window and keeps the few inside (runs ×
``WIDTH`` · 2 · √(n₁(1 − n₁/n)) rows are shuffled); their order gives the
threshold.  A run whose threshold lies outside is done again in a window eight
times as wide, so the result is exact whatever the keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.config import EPS, EffectConfig, Rules
from causeway.functions.hashing import md5_int
from causeway.functions.scalar import aipw_psi, propensity, weight_cap
from causeway.operators.joins import attach, join_null_safe, join_small, keep
from causeway.operators.nuisance.linear import column_means, linear_terms
from causeway.operators.nuisance.strata import oof_table

#: Half width of the threshold window, in standard deviations of the rank.
WIDTH = 6.0
P31 = 2147483647  # the Mersenne prime 2^31 − 1
MASK30 = (1 << 30) - 1
COEFS = ("a1", "b1", "c1", "a2", "b2", "c2")


def perm_salt(seed: int) -> str:
    return f"perm{seed}"


def key_constants(seed: int, salt: str | None = None) -> dict[str, tuple[int, int]]:
    """(multiplier, offset) per coefficient name, from md5 of the salt, so any
    engine derives the same numbers."""
    salt = salt or perm_salt(seed)
    out = {}
    for c in COEFS:
        hx = hashlib.md5(f"{salt}:{c}".encode()).hexdigest()
        out[c] = (int(hx[:15], 16) % (P31 - 1) + 1, int(hx[15:30], 16) % P31)
    return out


def _coef(run: Column, name: str, consts: dict[str, tuple[int, int]]) -> Column:
    """Coefficient of a run: ((run + 1)·m + o) mod (2^31 − 2) + 1 for the
    multipliers a, b (never 0), mod 2^31 − 1 for the offsets c."""
    m, o = consts[name]
    v = (run.cast("bigint") + 1) * F.lit(m) + F.lit(o)
    return v % F.lit(P31) if name.startswith("c") else v % F.lit(P31 - 1) + 1


def run_key(h: Column, run: Column, consts: dict[str, tuple[int, int]]) -> Column:
    """62-bit permutation key of a row in a run: two affine maps modulo
    2^31 − 1 of the row's 60-bit md5 integer (split in 30-bit halves), with
    multipliers that differ per run (so runs are not shifts of each other).
    One md5 per row serves every run; all products stay below 2^62, so BIGINT
    arithmetic is exact and the key is pure integer math in the scan stage."""
    ha = h.bitwiseAND(F.lit(MASK30))
    hb = F.shiftright(h, 30).bitwiseAND(F.lit(MASK30))
    k1 = (_coef(run, "a1", consts) * ha + _coef(run, "b1", consts) * hb + _coef(run, "c1", consts)) % F.lit(P31)
    k2 = (_coef(run, "a2", consts) * ha + _coef(run, "b2", consts) * hb + _coef(run, "c2", consts)) % F.lit(P31)
    return k1 * F.lit(1 << 31) + k2


def _runs(panel: DataFrame, runs: Sequence[int], cols: Sequence[str], seed: int) -> DataFrame:
    consts = key_constants(seed)
    keyed = panel.select(*cols, md5_int("id", perm_salt(seed)).alias("_h0"))
    which = F.sequence(F.lit(runs[0]), F.lit(runs[-1])) if len(runs) == runs[-1] - runs[0] + 1 else \
        F.array(*[F.lit(int(r)) for r in runs])
    exploded = keyed.select("*", F.explode(which).alias("run"))
    return exploded.withColumn("_h", run_key(F.col("_h0"), F.col("run"), consts)).drop("_h0")


def _arms(panel: DataFrame, group: list[str]) -> DataFrame:
    """Per group: rows (``_n``) and treated rows (``_n1``)."""
    return panel.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"),
                                     F.count(F.when(F.col("t") == 1, 1)).alias("_n1"))


def _window(n: Column, n1: Column, width: float) -> tuple[Column, Column]:
    """Key range in which the n₁-th smallest of n uniform keys lies but for
    ``width`` standard deviations (and a few ranks, for small n)."""
    share = n1 / n
    half = (F.lit(width) * F.sqrt(n1 * (F.lit(1.0) - share)) + F.lit(width)) / n
    full = float(P31) * float(1 << 31)
    low = F.floor(F.greatest(share - half, F.lit(0.0)) * full)
    high = F.ceil(F.least(share + half, F.lit(1.0)) * full)
    return low.cast("bigint"), high.cast("bigint")


def _window_picks(panel: DataFrame, runs: Sequence[int], seed: int, group: list[str], arms: DataFrame | tuple[int, int],
                  n_groups: int, width: float) -> DataFrame:
    """Rows (group…, run, _th, _tid) of the runs whose threshold lies in the window."""
    keyed = _runs(panel, runs, group + ["id"], seed)
    if group:
        keyed = join_small(keyed, arms, group, max_rows=n_groups)
        n, n1 = F.col("_n"), F.col("_n1")
    else:
        n, n1 = F.lit(arms[0]), F.lit(arms[1])
    low, high = _window(n, n1, width)
    inside = F.col("_h") >= low
    # keys below the window become one counted row per run, those inside stay
    kept = (keyed.where(F.col("_h") <= high)
            .groupBy(*group, "run", F.when(inside, F.col("_h")).alias("_th"), F.when(inside, F.col("id")).alias("_tid"))
            .agg(F.count(F.lit(1)).alias("_c"), F.max(n1).alias("_n1")))
    w = Window.partitionBy(*group, "run").orderBy(F.col("_th").asc_nulls_first(), "_tid") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = kept.withColumn("_cum", F.sum("_c").over(w))
    return cum.where(F.col("_th").isNotNull() & (F.col("_cum") - F.col("_c") < F.col("_n1"))
                     & (F.col("_cum") >= F.col("_n1"))).select(*group, "run", "_th", "_tid")


def permutation_thresholds(panel: DataFrame, runs: int, seed: int, group: Sequence[str] = (),
                           width: float = WIDTH) -> tuple[DataFrame, int] | dict[int, tuple]:
    """The key and id of the n₁-th smallest key of each run: a dictionary (run →
    key, id) without groups; with groups a table ``group…, run, _th, _tid`` and
    the number of groups.  A group without a treated row has none."""
    group = list(group)
    if not group:
        r = _arms(panel, []).first()
        n, n1 = r["_n"], r["_n1"]
        found: dict[int, tuple] = {}
        missing = list(range(runs)) if n1 else []
        while missing:
            got = _window_picks(panel, missing, seed, [], (n, n1), 1, width).collect()  # one row per run
            found.update({r["run"]: (r["_th"], r["_tid"]) for r in got})
            missing = [r for r in missing if r not in found]
            width *= 8
        return found
    arms = keep(_arms(panel, group).where(F.col("_n1") > 0))
    n_groups = arms.count()
    if not n_groups:
        return arms.select(*group, F.lit(0).alias("run"), F.lit(0).cast("bigint").alias("_th"),
                           F.lit(None).alias("_tid")).where(F.lit(False)), 0
    thresholds = keep(_window_picks(panel, range(runs), seed, group, arms, n_groups, width))
    while thresholds.count() < n_groups * runs:
        width *= 8
        # the missed (group, run) pairs only
        all_runs = arms.select(*group, F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
        missed = join_null_safe(all_runs, thresholds, group, ["run"], how="left").where("_th IS NULL").select(*group, "run")
        numbers = sorted(r["run"] for r in missed.select("run").distinct().collect())  # at most ``runs`` rows
        again = _window_picks(join_null_safe(panel, missed.select(*group).distinct(), group), numbers, seed, group, arms,
                              n_groups, width)
        thresholds = keep(thresholds.unionByName(join_null_safe(again, missed, group, ["run"])))
    return thresholds, n_groups


def _per_run(values: list, run: Column, dtype: str = "bigint") -> Column:
    """Per-run constant as an array literal indexed by the run number."""
    return F.element_at(F.array(*[F.lit(v).cast(dtype) for v in values]), run + 1)


def permuted(panel: DataFrame, runs: int, seed: int, cols: Sequence[str],
             group: Sequence[str] = (), width: float = WIDTH) -> DataFrame:
    """``runs`` copies of the panel with an exactly permuted treatment ``t``.

    Ungrouped, the thresholds (one per run) are read back and applied as array
    literals, so the final pass is a join-free scan-stage expression.  Grouped,
    they are joined back (the table has groups × runs rows, a known size)."""
    group = list(group)
    names = list(dict.fromkeys(group + ["id"] + list(cols)))
    rows = _runs(panel, range(runs), names, seed)
    if group:
        thr, n_groups = permutation_thresholds(panel, runs, seed, group, width)
        j = join_small(rows, thr, group + ["run"], "left", max_rows=n_groups * runs)
    else:
        picks = permutation_thresholds(panel, runs, seed, (), width)
        j = rows.withColumn("_th", _per_run([picks.get(r, (None, None))[0] for r in range(runs)], F.col("run"))) \
            .withColumn("_tid", _per_run([picks.get(r, (None, None))[1] for r in range(runs)], F.col("run"),
                                         dict(panel.dtypes)["id"]))
    tp = (F.col("_th").isNotNull() & ((F.col("_h") < F.col("_th"))
                                      | ((F.col("_h") == F.col("_th")) & (F.col("id") <= F.col("_tid")))))
    return j.withColumn("t", tp.cast("int")).drop("_h", "_th", "_tid")


def _outcome_stats(rows: DataFrame, keys: list[str], outcomes: Sequence[str],
                   y_scale: int | None) -> DataFrame:
    t = F.col("t")
    aggs = [F.count(F.when(t == 1, 1)).alias("n1"), F.count(F.when(t == 0, 1)).alias("n0")]
    for i, y in enumerate(outcomes):
        yv = F.col(y)
        yt = F.round(yv * F.lit(10.0 ** y_scale)).cast("bigint") if y_scale is not None else yv.cast("double")
        zero = F.lit(0).cast("bigint") if y_scale is not None else F.lit(0.0)
        aggs += [F.count(F.when((t == 1) & yv.isNotNull(), 1)).alias(f"m1_{i}"),
                 F.count(F.when((t == 0) & yv.isNotNull(), 1)).alias(f"m0_{i}"),
                 F.coalesce(F.sum(F.when(t == 1, yt)), zero).alias(f"s1_{i}"),
                 F.coalesce(F.sum(F.when(t == 0, yt)), zero).alias(f"s0_{i}")]
    return rows.groupBy(*keys).agg(*aggs)


def estimates_from_stats(stats: DataFrame, oof: DataFrame, cfg: EffectConfig, group: list[str],
                         y_scale: int | None, fold: str = "fold") -> DataFrame:
    """ATE / ATT / ATO per group from own-fold sums and out-of-fold cell nuisances."""
    j = join_null_safe(stats, oof, group + [fold, "cell"])
    e, mu1, mu0 = F.col("e"), F.col("mu1"), F.col("mu0")
    n1, n0 = F.col("m1"), F.col("m0")  # rows with an outcome: the others have no influence value
    scale = 10.0 ** y_scale if y_scale is not None else 1.0
    s1, s0 = F.col("s1").cast("double") / scale, F.col("s0").cast("double") / scale
    psi_sum = (s1 - n1 * mu1) / e - (s0 - n0 * mu0) / (1 - e) + (n1 + n0) * (mu1 - mu0)
    term_sum = (s1 - n1 * mu0) - (e / (1 - e)) * (s0 - n0 * mu0)
    w = weight_cap(F.lit(4.0) * e * (1 - e), cfg.weight_clip)
    agg = j.groupBy(*group).agg(
        F.sum(n1 + n0).alias("n"), F.sum(n1).alias("n_treated"), F.sum(psi_sum).alias("_spsi"),
        F.sum(term_sum).alias("_sterm"), F.sum(w * psi_sum).alias("_swpsi"),
        F.sum(w * (n1 + n0)).alias("_sw"))
    p1 = F.col("n_treated") / F.col("n")
    return agg.select(*group, "n", (F.col("_spsi") / F.col("n")).alias("ate"),
                      ((F.col("_sterm") / F.col("n")) / (p1 + EPS)).alias("att"),
                      (F.col("_swpsi") / (F.col("_sw") + EPS)).alias("ato"))


def placebo_runs(panel: DataFrame, cell: Column | str, cfg: EffectConfig, runs: int,
                 outcomes: Sequence[str] = ("y",), group: Sequence[str] = (),
                 y_scale: int | None = None, fold: str = "fold") -> DataFrame:
    """Per (group, run, outcome): the cross-fitted ATE/ATT/ATO under permuted T,
    over the rows with all ``outcomes`` (T is permuted among them)."""
    group = list(group)
    c = F.col(cell) if isinstance(cell, str) else cell
    # The narrow panel (keys, fold, cell, t, outcomes) is read by two passes
    # over rows × runs: kept once.
    base = keep(panel.select(*group, "id", "t", fold, c.alias("cell"), *outcomes)
                .dropna(subset=list(outcomes)))
    rows = permuted(base, runs, cfg.seed, [fold, "cell", *outcomes], group)
    keys = group + ["run", fold, "cell"]
    stats = keep(_outcome_stats(rows, keys, outcomes, y_scale))
    parts = []
    for i, y in enumerate(outcomes):
        st = stats.select(*keys, "n1", "n0", F.col(f"m1_{i}").alias("m1"), F.col(f"m0_{i}").alias("m0"),
                          F.col(f"s1_{i}").alias("s1"), F.col(f"s0_{i}").alias("s0"))
        oof = oof_table(st, cfg, group + ["run"], fold, y_scale)
        est = estimates_from_stats(st, oof, cfg, group + ["run"], y_scale, fold)
        parts.append(est.withColumn("outcome", F.lit(y)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------ linear learners
def _sum_names(q: int) -> list[str]:
    """Columns of a Gram accumulator of q terms: X'X (upper half), X'y."""
    return [f"xx{i}_{j}" for i in range(q) for j in range(i, q)] + [f"xy{i}" for i in range(q)]


def _gram_sums(xs: Sequence[Column], y: Column) -> list[Column]:
    q = len(xs)
    return [F.sum(xs[i] * xs[j]).alias(f"xx{i}_{j}") for i in range(q) for j in range(i, q)] + \
        [F.sum(xs[i] * y).alias(f"xy{i}") for i in range(q)]


def solve_stack(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Least squares of a stack of Gram systems whose first term is the constant
    (so xx[:, 0, 0] counts rows): Cholesky of the standardised centred matrix,
    least squares where it is singular, the mean where rows are no more than
    terms, 0 where there are none."""
    n = xx[:, 0, 0]
    rows = np.where(n > 0, n, 1.0)
    q = xx.shape[1]
    mean_x, mean_y = xx[:, 0, 1:] / rows[:, None], xy[:, 0] / rows
    beta = np.zeros((len(n), q - 1))
    if q > 1:
        sxx = xx[:, 1:, 1:] - rows[:, None, None] * mean_x[:, :, None] * mean_x[:, None, :]
        sxy = xy[:, 1:] - rows[:, None] * mean_x * mean_y[:, None]
        size = np.sqrt(np.maximum(np.einsum("aii->ai", sxx), 0.0))
        scale = np.where(size > 0, size, 1.0)
        unit = sxx / (scale[:, :, None] * scale[:, None, :])
        full = (n > q) & (size > 0).all(axis=1)
        full[full] = np.linalg.eigvalsh(unit[full])[:, 0] > 1e-10
        low = np.linalg.cholesky(unit[full])
        half = np.linalg.solve(low, (sxy[full] / scale[full])[:, :, None])
        beta[full] = np.linalg.solve(np.transpose(low, (0, 2, 1)), half)[:, :, 0] / scale[full]
        for i in np.flatnonzero((n > q) & ~full):
            beta[i] = np.linalg.lstsq(sxx[i], sxy[i], rcond=None)[0]
    b0 = np.where(n > 0, mean_y - (mean_x * beta).sum(axis=1), 0.0)
    return np.concatenate([b0[:, None], beta], axis=1)


def _solver(q: int, keys: list[str], outcomes: int):
    """Arrow function: rows of out-of-fold Gram sums (treated ``a_``, all ``f_``)
    to the coefficients of the propensity and of both arms of every outcome."""
    names = _sum_names(q)
    n_xx = q * (q + 1) // 2
    upper = [(i, j) for i in range(q) for j in range(i, q)]

    def matrix(cols: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(cols[0]), q, q))
        for (i, j), c in zip(upper, cols):
            out[:, i, j] = out[:, j, i] = c
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def read(prefix: str, part: list[str]) -> list[np.ndarray]:
                return [batch.column(prefix + c).to_numpy(zero_copy_only=False).astype(np.float64) for c in part]

            treated, everyone = matrix(read("a_", names[:n_xx])), matrix(read("f_", names[:n_xx]))
            # the propensity regresses t on x: X't is the sum of x over the treated
            coefs = [solve_stack(everyone, treated[:, 0, :])]
            for k in range(outcomes):
                y1 = np.array(read(f"a{k}_", names[n_xx:])).T
                y = np.array(read(f"f{k}_", names[n_xx:])).T
                coefs += [solve_stack(treated, y1), solve_stack(everyone - treated, y - y1)]
            lists = [pa.array(list(c), pa.list_(pa.float64())) for c in coefs]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *lists],
                                             names=[*keys, "ce", *[f"c{a}_{k}" for k in range(outcomes) for a in (1, 0)]])
    return run


def placebo_linear_runs(panel: DataFrame, xcols: Sequence[str], cfg: EffectConfig, runs: int,
                        outcomes: Sequence[str] = ("y",), group: Sequence[str] = (), fold: str = "fold") -> DataFrame:
    """Per (group, run, outcome): ATE/ATT/ATO under permuted T, cross-fitted with
    linear learners — least squares of each outcome per arm and a linear
    propensity, clipped — over the rows with all ``outcomes``.  NULL covariates
    count as 0, as in the linear learners.

    Two passes over rows × runs (Gram sums of the treated; influence sums) and
    the threshold pass; nothing per run reaches the driver but the thresholds."""
    group, outcomes = list(group), list(outcomes)
    base = keep(panel.select(*group, "id", "t", fold, *xcols, *outcomes).dropna(subset=outcomes))
    centre = column_means(base, xcols)
    xs = linear_terms(xcols, centre)
    q = len(xs)
    xnames = [f"_x{i}" for i in range(1, q)]
    narrow = base.select(*group, "id", "t", fold, *[x.alias(n) for x, n in zip(xs[1:], xnames)],
                         *[F.col(y).cast("double").alias(f"_y{k}") for k, y in enumerate(outcomes)])
    terms = [F.lit(1.0), *[F.col(c) for c in xnames]]
    ys = [f"_y{k}" for k in range(len(outcomes))]
    cols = [fold, *xnames, *ys]
    n_xx = q * (q + 1) // 2
    names = _sum_names(q)

    def sums(prefix: str) -> list[Column]:
        out = [c.alias(prefix + "_" + n) for c, n in zip(_gram_sums(terms, F.lit(0.0))[:n_xx], names)]
        for k, y in enumerate(ys):
            out += [c.alias(f"{prefix}{k}_{n}") for c, n in zip(_gram_sums(terms, F.col(y))[n_xx:], names[n_xx:])]
        return out

    def columns(prefix: str) -> list[str]:
        return [f"{prefix}_{n}" for n in names[:n_xx]] + [f"{prefix}{k}_{n}" for k in range(len(ys)) for n in names[n_xx:]]

    rows = permuted(narrow, runs, cfg.seed, cols, group)
    own = rows.where("t = 1").groupBy(*group, "run", fold).agg(*sums("a"))
    folds = narrow.groupBy(*group, fold).agg(*sums("f"))
    every = folds.select(*group, fold, *columns("f"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    both = join_null_safe(every, own, [*group, fold], ["run"], how="left")
    whole = Window.partitionBy(*group, "run")
    oof = both.select(*group, "run", fold, *[
        (F.sum(F.coalesce(c, F.lit(0.0))).over(whole) - F.coalesce(c, F.lit(0.0))).alias(c)
        for c in [*columns("a"), *columns("f")]])
    keys = [*group, "run", fold]
    kinds = dict(oof.dtypes)
    coef_names = ["ce", *[f"c{a}_{k}" for k in range(len(ys)) for a in (1, 0)]]
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keys] + [f"{c} array<double>" for c in coef_names])
    coefs = oof.mapInArrow(_solver(q, keys, len(ys)), schema)
    # folds × runs rows per group: a known size without groups
    j = join_small(rows, coefs, keys, max_rows=None if group else cfg.n_splits * runs)

    def linear(c: str) -> Column:
        out = F.col(c)[0]
        for i, x in enumerate(xnames):
            out = out + F.col(c)[i + 1] * F.col(x)
        return out

    j = j.withColumn("e", propensity(linear("ce"), cfg.trim, cfg.ps_clip))
    t, e = F.col("t"), F.col("e")
    w = weight_cap(F.lit(4.0) * e * (1 - e), cfg.weight_clip)
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(t).alias("n1"), F.sum(w).alias("sw")]
    for k, y in enumerate(ys):
        mu1, mu0 = linear(f"c1_{k}"), linear(f"c0_{k}")
        psi = aipw_psi(t, F.col(y), mu1, mu0, e)
        aggs += [F.sum(psi).alias(f"p{k}"), F.sum(w * psi).alias(f"wp{k}"),
                 F.sum(t * (F.col(y) - mu0) - (1 - t) * (e / (1 - e)) * (F.col(y) - mu0)).alias(f"a{k}")]
    total = j.groupBy(*group, "run").agg(*aggs)
    n, p1 = F.col("n"), F.col("n1") / F.col("n")
    estimates = F.explode(F.array(*[F.struct(
        (F.col(f"p{k}") / n).alias("ate"), ((F.col(f"a{k}") / n) / (p1 + EPS)).alias("att"),
        (F.col(f"wp{k}") / (F.col("sw") + EPS)).alias("ato"), F.lit(y).alias("outcome"))
        for k, y in enumerate(outcomes)]))
    return total.select(*group, "run", "n", estimates.alias("_e")).select(*group, "run", "n", "_e.*")


def permutation_pvalue(runs_df: DataFrame, observed: DataFrame, estimand: str,
                       group: Sequence[str] = ()) -> DataFrame:
    """(#{|v| ≥ |est|} + 1) / (runs + 1) per group; ``observed`` has ``est``."""
    group = list(group)
    v = F.col(estimand.lower())
    j = attach(runs_df, observed.select(*group, F.col("est").alias("_obs")), group)
    return j.groupBy(*group).agg(
        F.first("_obs").alias("est"), F.count(F.lit(1)).alias("runs"),
        F.count(F.when(F.abs(v) >= F.abs(F.col("_obs")), 1)).alias("n_extreme"),
    ).withColumn("p_value", (F.col("n_extreme") + 1) / (F.col("runs") + 1))


def verdict(ovl: Column, ks: Column, smd_max: Column, placebo_p: Column, negctrl_p: Column | None,
            rules: Rules = Rules()) -> list[Column]:
    """The four credibility checks and the verdict (4 → credible, 2-3 →
    doubtful, else fail).  ``placebo_pass`` keeps the reference direction
    (p ≥ α passes); ``perm_significant`` is the conventional reading."""
    overlap = F.coalesce((ovl >= rules.ovl_min) & (ks <= rules.ks_max), F.lit(False))
    balance = F.coalesce(smd_max <= rules.smd_max, F.lit(False))
    placebo = F.coalesce(placebo_p >= rules.placebo_alpha, F.lit(False))
    negctrl = F.lit(True) if negctrl_p is None else F.coalesce(negctrl_p >= rules.nc_alpha, F.lit(True))
    n_pass = sum(x.cast("int") for x in (overlap, balance, placebo, negctrl))
    label = F.when(n_pass == 4, "credible").when(n_pass >= 2, "doubtful").otherwise("fail")
    return [overlap.alias("overlap_pass"), balance.alias("balance_pass"),
            placebo.alias("placebo_pass"), negctrl.alias("negctrl_pass"),
            n_pass.alias("n_pass"), label.alias("verdict"),
            (placebo_p <= rules.placebo_alpha).alias("perm_significant")]
