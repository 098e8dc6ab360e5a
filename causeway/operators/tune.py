"""Hyper-parameter search with Parzen-estimator proposals.

A trial grows the cross-fitted forest nuisances with one parameter set, learns
τ̂ by a cross-fitted forest of ψ, and is scored by one plan of distributed
aggregates.  Objectives:

* ``nauuc``     — mean over folds of the uncentred nAUUC (oracle ≤ 0 → 0);
* ``nauuc_ci``  — that minus λ · (normalised 95 % CI width of ψ), λ = 0.15;
* ``fused``     — the mean fold nAUUC of (1 − η)·τ̂ + η·r, r a pointwise forest
  ranker of ψ on half of the rows (η = 0.3), minus 0.1 · CI width;
* ``min_var``   — minus the mean over folds of var(ψ)/n_fold;
* ``band``      — the nAUUC inside the overlap band, × 0.6 if the band holds
  fewer than max(120, 3k) rows and × 0.85 if it covers under 25 %;
* ``light``     — the nAUUC inside the band (the base band if it holds fewer than
  max(100, 3k) rows), × 0.9 if it covers under 25 %.

Proposals depend on the seed and the trials so far and nothing else: the first
``STARTUP`` are random; then the trials are split into the best quarter and the
rest, each parameter gets a Parzen estimate of both, and of ``CANDIDATES``
draws from the good one the draw with the largest density ratio is tried.  So a
search that keeps its trials in a folder goes on where it stopped, as if it had
never stopped.  It ends early once the objective reaches ``stop``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.config import EffectConfig
from causeway.functions.scalar import fused_score
from causeway.operators import estimate, ranking
from causeway.operators.clean import banded
from causeway.operators.joins import caches, settle
from causeway.operators.nuisance.calibrate import calibrate
from causeway.operators.nuisance.forest import forest_nuisance
from causeway.operators.trees import Family, grow, predict

# Objective weights and band penalties.
LAMBDA_CI = 0.15
ETA_FUSED, LAMBDA_FUSED = 0.3, 0.1
SMALL_BAND_FACTOR, LOW_COVERAGE_FACTOR, LOW_COVERAGE = 0.6, 0.85, 0.25
LIGHT_FACTOR = 0.9
OBJECTIVES = ("nauuc", "nauuc_ci", "fused", "min_var", "band", "light")

STARTUP, CANDIDATES, GOOD_SHARE = 6, 24, 0.25


@dataclass(frozen=True)
class Dim:
    """One parameter: a range (``log``: on a logarithmic scale; ``whole``
    numbers), or choices."""

    name: str
    low: float = 0.0
    high: float = 1.0
    log: bool = False
    whole: bool = False
    choices: tuple = ()

    def unit(self, value) -> float:
        """A number of the range on [0, 1]."""
        f = math.log if self.log else float
        return (f(value) - f(self.low)) / (f(self.high) - f(self.low))

    def value(self, u: float):
        u = min(max(u, 0.0), 1.0)
        x = math.exp(math.log(self.low) + u * math.log(self.high / self.low)) if self.log else self.low + u * (self.high - self.low)
        return int(round(x)) if self.whole else float(x)


SPACE = (Dim("depth", 2, 6, whole=True), Dim("min_leaf", 5, 80, log=True, whole=True), Dim("trees", 4, 24, log=True, whole=True),
         Dim("feature_share", 0.3, 1.0), Dim("trim", 1e-3, 5e-2, log=True), Dim("calibration", choices=("none", "sigmoid")))


def _parzen(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Density on [0, 1] of normal kernels at the points, and one flat kernel."""
    if not len(points):
        return np.ones(len(x))
    width = max(0.1, 1.0 / (1 + len(points)))
    kernels = np.exp(-0.5 * ((x[:, None] - points[None, :]) / width) ** 2) / (width * math.sqrt(2 * math.pi))
    return (kernels.sum(axis=1) + 1.0) / (len(points) + 1)


def propose(trials: Sequence[dict], seed: int, space: Sequence[Dim] = SPACE) -> dict:
    """Parameters of the next trial (number ``len(trials)``)."""
    rng = np.random.RandomState((seed * 1_000_003 + len(trials)) % 2 ** 32)
    scored = sorted((t for t in trials if t.get("objective") is not None), key=lambda t: (-t["objective"], t["trial"]))
    n_good = max(1, math.ceil(GOOD_SHARE * len(scored)))
    good, rest = scored[:n_good], scored[n_good:]
    out = {}
    for d in space:
        random = len(trials) < STARTUP or not rest
        if d.choices:
            names = [str(c) for c in d.choices]
            counts = [np.array([1.0 + sum(str(t[d.name]) == c for t in part) for c in names]) for part in (good, rest)]
            p = np.ones(len(names)) if random else (counts[0] / counts[0].sum()) / (counts[1] / counts[1].sum())
            draw = rng.choice(len(names), p=p / p.sum())
            out[d.name] = d.choices[draw]
            continue
        draws = rng.uniform(size=CANDIDATES)
        if random:
            out[d.name] = d.value(draws[0])
            continue
        a, b = (np.array([d.unit(t[d.name]) for t in part]) for part in (good, rest))
        width = max(0.1, 1.0 / (1 + len(a)))
        near = np.clip(a[rng.randint(len(a), size=CANDIDATES)] + width * rng.standard_normal(CANDIDATES), 0, 1)
        draws = np.where(rng.uniform(size=CANDIDATES) < 1.0 / (len(a) + 1), draws, near)
        out[d.name] = d.value(float(draws[np.argmax(_parzen(a, draws) / _parzen(b, draws))]))
    return out


# ------------------------------------------------------------ one trial
def trial_scores(panel: DataFrame, xcols: Sequence[str], cfg: EffectConfig, folds: Sequence[int], params: dict,
                 fused: bool = False, seed: int = 42) -> DataFrame:
    """The nuisance table of a trial with its τ̂ (fused with the ranker if asked)."""
    mtry = max(1, round(params["feature_share"] * len(xcols)))
    shape = {"trees": params["trees"], "depth": params["depth"], "min_leaf": params["min_leaf"], "mtry": mtry}
    cfg = EffectConfig(cfg.n_splits, params["trim"], cfg.ps_clip, cfg.weight_clip, cfg.seed, cfg.rules)
    nuis = settle(forest_nuisance(panel, xcols, cfg, folds, **shape))
    if params.get("calibration", "none") != "none":
        nuis = settle(calibrate(nuis, cfg, folds, params["calibration"]))
    known = F.col("psi").isNotNull()
    families = [Family("tau", F.col("psi"), known)]
    if fused:
        families.append(Family("rank_score", F.col("psi"), known & (F.pmod(F.xxhash64("id"), F.lit(2)) == 0)))
    out = predict(nuis, grow(nuis, xcols, families, folds, seed=seed, **shape))
    return settle(out.withColumn("tau", fused_score("tau", "rank_score", ETA_FUSED)) if fused else out)


def evaluate(tau: DataFrame, objective: str, band: tuple[float, float], k: int,
             base_band: tuple[float, float] = (0.1, 0.9)) -> DataFrame:
    """One row: nauuc, ci_width_norm, fold_variance, band_coverage, n_band,
    band_nauuc, objective — a single plan over the trial's table."""
    if objective not in OBJECTIVES:
        raise ValueError(f"objective must be one of {OBJECTIVES}")
    per_fold = ranking.nauuc(tau, "tau", group=["fold"], centered=False)
    row = per_fold.agg(F.coalesce(F.avg("nauuc"), F.lit(0.0)).alias("nauuc"))
    ci = estimate.ci_width_normalised(tau).agg(F.coalesce(F.max("ci_width_norm"), F.lit(0.0)).alias("ci_width_norm"))
    var = estimate.fold_variance(tau).agg(F.coalesce(F.max("fold_variance"), F.lit(0.0)).alias("fold_variance"))
    inside = F.col("e").between(*band)
    cover = tau.agg(F.count(F.when(inside, 1)).alias("n_band"),
                    F.coalesce(F.try_divide(F.count(F.when(inside, 1)), F.count(F.lit(1))), F.lit(0.0)).alias("band_coverage"))
    row = row.crossJoin(F.broadcast(ci)).crossJoin(F.broadcast(var)).crossJoin(F.broadcast(cover))   # one row each
    band_nauuc: Column = F.lit(None).cast("double")
    if objective in ("band", "light"):
        rows = tau.where(inside) if objective == "band" else banded(tau, band, k, base_band)
        inner = ranking.nauuc(rows, "tau", centered=True, on_zero="zero").agg(F.coalesce(F.max("nauuc"), F.lit(0.0)).alias("_b"))
        row, band_nauuc = row.crossJoin(F.broadcast(inner)), F.col("_b")
    low = F.col("band_coverage") < LOW_COVERAGE
    small = F.col("n_band") < max(120, 3 * k)
    value = {"nauuc": F.col("nauuc"), "nauuc_ci": F.col("nauuc") - LAMBDA_CI * F.col("ci_width_norm"),
             "fused": F.col("nauuc") - LAMBDA_FUSED * F.col("ci_width_norm"), "min_var": -F.col("fold_variance"),
             "band": band_nauuc * F.when(small, SMALL_BAND_FACTOR).otherwise(1.0) * F.when(low, LOW_COVERAGE_FACTOR).otherwise(1.0),
             "light": band_nauuc * F.when(low, LIGHT_FACTOR).otherwise(1.0)}[objective]
    return row.select("nauuc", "ci_width_norm", "fold_variance", "band_coverage", "n_band", band_nauuc.alias("band_nauuc"),
                      value.alias("objective"))


# ------------------------------------------------------------ the search
_SCORES = "nauuc double, ci_width_norm double, fold_variance double, band_coverage double, n_band long, band_nauuc double, objective double"


def _schema(space: Sequence[Dim]) -> str:
    kinds = ["string" if d.choices else "long" if d.whole else "double" for d in space]
    return ", ".join(["trial int", *[f"{d.name} {k}" for d, k in zip(space, kinds)], _SCORES])


def read_trials(spark: SparkSession, path: str, space: Sequence[Dim] = SPACE) -> list[dict]:
    """The trials a folder holds, in order (a row per trial)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return []
    rows = spark.read.schema(_schema(space)).parquet(f"{path}/*").collect()
    return sorted((r.asDict() for r in rows), key=lambda t: t["trial"])


def tune(panel: DataFrame, xcols: Sequence[str], cfg: EffectConfig, folds: Sequence[int], objective: str = "nauuc_ci",
         trials: int = 30, seed: int = 42, stop: float | None = 0.5, band: tuple[float, float] = (0.2, 0.8),
         path: str | None = None, space: Sequence[Dim] = SPACE,
         scores: Callable[..., DataFrame] = trial_scores) -> DataFrame:
    """The trial table (parameters, scores, ``best``).  With ``path`` every trial
    is written to a folder of its own when it is done, and those that are there
    already count."""
    spark = panel.sparkSession
    done = read_trials(spark, path, space) if path else []
    while len(done) < trials and not (stop is not None and done and done[-1]["objective"] >= stop):
        params = propose(done, seed, space)
        with caches(spark):
            tau = scores(panel, xcols, cfg, folds, params, fused=objective == "fused", seed=seed)
            found = evaluate(tau, objective, band, len(folds)).first().asDict()
        row = {"trial": len(done), **params, **found}
        if path:
            spark.createDataFrame([tuple(row[f.split()[0]] for f in _schema(space).split(", "))], _schema(space)) \
                .coalesce(1).write.mode("overwrite").parquet(f"{path}/trial-{len(done):05d}")
        done.append(row)
    best = max(done, key=lambda t: (t["objective"], -t["trial"]))
    names = [f.split()[0] for f in _schema(space).split(", ")]
    return spark.createDataFrame([(*[t[c] for c in names], t is best) for t in done], _schema(space) + ", best boolean")


def best_params(table: DataFrame, space: Sequence[Dim] = SPACE) -> dict:
    """Parameters of the best trial."""
    row = table.where("best").first().asDict()
    return {d.name: row[d.name] for d in space}


