"""Linear and logistic nuisance learners fitted from grouped Gram sums.

* ``ols``: per (fold, arm) least squares of y on [1, x].  One aggregate
  gives the Gram sums of every (fold, arm); the out-of-fold Gram is the
  total minus the own fold's, solved on the driver (p × p, tiny) and the
  coefficients come back as literal column expressions — no join.
* ``logit``: Newton/IRLS for the propensity.  Each iteration is one
  aggregate in which every row adds its weighted Gram terms to the k − 1
  models that train on it (fold ≠ own), so all folds advance together.

Degenerate arms fall back to the arm mean of the training folds (or 0 when
the arm is empty); a singular system is solved by least squares.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.config import EffectConfig
from causeway.functions.scalar import aipw_psi, propensity


def linear_terms(xcols: Sequence[str], centre: Sequence[float] | None = None) -> list[Column]:
    """[1, x - centre], NULL as 0."""
    xs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in xcols]
    return [F.lit(1.0)] + [x - F.lit(m) for x, m in zip(xs, centre or [0.0] * len(xs))]


def column_means(df: DataFrame, xcols: Sequence[str]) -> list[float]:
    """Overall means (NULL as 0): the centre the Gram sums are taken around, so
    that a large offset costs no precision."""
    if not xcols:
        return []
    row = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(linear_terms(xcols)[1:])]).first()
    return [float(v or 0.0) for v in row]


def gram_sums(df: DataFrame, xcols: Sequence[str], target: str, keys: Sequence[str],
              where: Column | None = None, centre: Sequence[float] | None = None) -> dict[tuple, dict]:
    """Per key tuple: n, X'X, X'y, Σy (small, collected), of X minus ``centre``."""
    xs = linear_terms(xcols, centre)
    q = len(xs)
    y = F.col(target).cast("double")
    ok = y.isNotNull() if where is None else (y.isNotNull() & where)
    aggs = [F.count(F.when(ok, 1)).alias("n"), F.sum(F.when(ok, y)).alias("sy")]
    for i in range(q):
        aggs.append(F.sum(F.when(ok, xs[i] * y)).alias(f"xy{i}"))
        for j in range(i, q):
            aggs.append(F.sum(F.when(ok, xs[i] * xs[j])).alias(f"xx{i}_{j}"))
    out = {}
    for r in df.groupBy(*keys).agg(*aggs).collect():
        g = np.zeros((q, q))
        for i in range(q):
            for j in range(i, q):
                g[i, j] = g[j, i] = r[f"xx{i}_{j}"] or 0.0
        out[tuple(r[k] for k in keys)] = {"n": r["n"], "sy": r["sy"] or 0.0, "xx": g,
                                          "xy": np.array([r[f"xy{i}"] or 0.0 for i in range(q)])}
    return out


def _solve(n: float, xx: np.ndarray, xy: np.ndarray, sy: float) -> np.ndarray:
    """OLS with intercept from raw sums, solved in centred form."""
    q = xx.shape[0]
    if n <= 0:
        return np.zeros(q)
    mean_x = xx[0, 1:] / n
    mean_y = sy / n
    if q == 1:
        return np.array([mean_y])
    sxx = xx[1:, 1:] - n * np.outer(mean_x, mean_x)
    sxy = xy[1:] - n * mean_x * mean_y
    beta = np.linalg.lstsq(sxx, sxy, rcond=None)[0] if n > q else np.zeros(q - 1)
    return np.concatenate([[mean_y - mean_x @ beta], beta])


def ols_oof(df: DataFrame, xcols: Sequence[str], y: str, folds: Sequence[int], fold: str = "fold",
            t: str = "t") -> dict[tuple[int, int], np.ndarray]:
    """Out-of-fold coefficients per (fold, arm)."""
    centre = column_means(df, xcols)
    stats = gram_sums(df, xcols, y, [fold, t], centre=centre)
    coefs = {}
    for arm in (0, 1):
        own = {f: stats.get((f, arm)) for f in folds}
        tot_n = sum(s["n"] for s in own.values() if s)
        tot_xx = sum((s["xx"] for s in own.values() if s), np.zeros((len(xcols) + 1,) * 2))
        tot_xy = sum((s["xy"] for s in own.values() if s), np.zeros(len(xcols) + 1))
        tot_sy = sum(s["sy"] for s in own.values() if s)
        for f in folds:
            s = own[f]
            n = tot_n - (s["n"] if s else 0)
            xx = tot_xx - (s["xx"] if s else 0)
            xy = tot_xy - (s["xy"] if s else 0)
            sy = tot_sy - (s["sy"] if s else 0)
            b = _solve(n, xx, xy, sy)
            b[0] -= b[1:] @ np.array(centre)        # back to uncentred columns
            coefs[(f, arm)] = b
    return coefs


def _predict(coefs: dict[tuple[int, int], np.ndarray], arm: int, xcols: Sequence[str],
             folds: Sequence[int], fold: str) -> Column:
    xs = linear_terms(xcols)
    expr = None
    for f in folds:
        b = coefs[(f, arm)]
        lin = sum((F.lit(float(b[i])) * xs[i] for i in range(len(xs))), F.lit(0.0))
        expr = F.when(F.col(fold) == f, lin) if expr is None else expr.when(F.col(fold) == f, lin)
    return expr


def logit_oof(df: DataFrame, xcols: Sequence[str], folds: Sequence[int], fold: str = "fold",
              t: str = "t", iters: int = 50, ridge: float = 1e-6) -> dict[int, np.ndarray]:
    """Cross-fitted logistic regression by IRLS; one aggregate per iteration
    for all folds.  Covariates are standardised inside (global mean / sd).
    Raises if ``iters`` steps don't bring the largest change below 1e-6."""
    mom = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in xcols],
                  *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in xcols]).first()
    z = [F.lit(1.0)] + [F.coalesce((F.col(c).cast("double") - (mom[f"m_{c}"] or 0.0))
                                   / F.lit((mom[f"s_{c}"] or 1.0) or 1.0), F.lit(0.0)) for c in xcols]
    q = len(z)
    beta = {f: np.zeros(q) for f in folds}
    tc = F.col(t).cast("double")
    for _ in range(iters):
        aggs = []
        for f in folds:
            eta = sum((F.lit(float(beta[f][i])) * z[i] for i in range(q)), F.lit(0.0))
            p = 1.0 / (1.0 + F.exp(-eta))
            w = p * (1 - p)
            train = F.col(fold) != f
            for i in range(q):
                aggs.append(F.sum(F.when(train, z[i] * (tc - p))).alias(f"g{f}_{i}"))
                for j in range(i, q):
                    aggs.append(F.sum(F.when(train, w * z[i] * z[j])).alias(f"h{f}_{i}_{j}"))
        r = df.agg(*aggs).first()
        step = 0.0
        for f in folds:
            g = np.array([r[f"g{f}_{i}"] or 0.0 for i in range(q)])
            h = np.zeros((q, q))
            for i in range(q):
                for j in range(i, q):
                    h[i, j] = h[j, i] = r[f"h{f}_{i}_{j}"] or 0.0
            h += ridge * np.eye(q) * max(1.0, np.trace(h) / q)
            delta = np.linalg.lstsq(h, g, rcond=None)[0]
            beta[f] = beta[f] + delta
            step = max(step, float(np.max(np.abs(delta))))
        if step < 1e-8:
            break
    if not step < 1e-6:
        raise RuntimeError(f"the propensity model did not settle in {iters} steps (last change {step:.3g})")
    # back to the raw scale: eta = b0 + Σ b_i (x_i − m_i)/s_i
    out = {}
    for f in folds:
        b = beta[f]
        scale = np.array([(mom[f"s_{c}"] or 1.0) or 1.0 for c in xcols])
        mean = np.array([mom[f"m_{c}"] or 0.0 for c in xcols])
        raw = b[1:] / scale
        out[f] = np.concatenate([[b[0] - raw @ mean], raw])
    return out


def linear_nuisance(panel: DataFrame, xcols: Sequence[str], cfg: EffectConfig, folds: Sequence[int],
                    fold: str = "fold", ps_xcols: Sequence[str] | None = None,
                    propensity_model: str = "logit", e_col: str | None = None) -> DataFrame:
    """Row-level e, mu1, mu0, psi from OLS outcome models and a logit
    propensity (or an existing ``e_col``)."""
    folds = sorted(folds)
    coefs = ols_oof(panel, xcols, "y", folds, fold)
    out = panel.withColumn("mu1", _predict(coefs, 1, xcols, folds, fold)) \
               .withColumn("mu0", _predict(coefs, 0, xcols, folds, fold))
    if e_col is not None:
        out = out.withColumn("e_raw", F.col(e_col))
    else:
        ps_x = list(ps_xcols or xcols)
        betas = logit_oof(panel, ps_x, folds, fold)
        xs = linear_terms(ps_x)
        eta = None
        for f in folds:
            lin = sum((F.lit(float(betas[f][i])) * xs[i] for i in range(len(xs))), F.lit(0.0))
            eta = F.when(F.col(fold) == f, lin) if eta is None else eta.when(F.col(fold) == f, lin)
        out = out.withColumn("e_raw", 1.0 / (1.0 + F.exp(-eta)))
    out = out.withColumn("e", propensity("e_raw", cfg.trim, cfg.ps_clip))
    return out.withColumn("psi", aipw_psi("t", "y", "mu1", "mu0", "e"))
