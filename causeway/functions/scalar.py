"""Null-safe scalar column expressions.

Spark's ``least``/``greatest`` skip NULLs (``greatest(least(NULL, .9), .1)``
is 0.9), so every clamp is guarded.  Missing values are NULL, never NaN:
:func:`nan_to_null` is applied at ingest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.config import EPS, NA_LEVEL


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def clip(c: Column | str, lo: float | None, hi: float | None) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL."""
    c = col(c)
    out = c
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    return F.when(c.isNotNull(), out)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI-safe)."""
    return F.try_divide(col(a), col(b))


def log1p_pos(c: Column | str) -> Column:
    """log1p(max(x, 0)); NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def category(c: Column | str) -> Column:
    """Categorical normalisation: text, missing → the NA level."""
    return F.coalesce(col(c).cast("string"), F.lit(NA_LEVEL))


def propensity(e_raw: Column | str, trim: float, ps_clip: tuple[float, float] | None) -> Column:
    """Fold-level trim, then the estimator-level clip."""
    e = clip(e_raw, trim, 1.0 - trim)
    if ps_clip is not None:
        e = clip(e, ps_clip[0], ps_clip[1])
    return e


def aipw_psi(t: Column | str, y: Column | str, mu1: Column | str, mu0: Column | str,
             e: Column | str) -> Column:
    """Doubly robust pseudo-effect ψ."""
    t, y, mu1, mu0, e = map(col, (t, y, mu1, mu0, e))
    ec = F.least(F.greatest(e, F.lit(EPS)), F.lit(1.0 - EPS))
    return (t * (y - mu1) / ec - (1 - t) * (y - mu0) / (1.0 - ec) + (mu1 - mu0))


def weight_cap(c: Column, cap: float | None) -> Column:
    return c if cap is None else clip(c, 0.0, cap)


def significance_label(lb99: Column | str, lb90: Column | str) -> Column:
    """``strong`` if the 99 % lower bound is above 0, ``medium`` if the 90 % one is."""
    lb99, lb90 = col(lb99), col(lb90)
    return (F.when(lb99 > 0, F.lit("strong"))
            .when(lb90 > 0, F.lit("medium"))
            .otherwise(F.lit("none")))


def fused_score(tau: Column | str, rank_score: Column | str, eta: float) -> Column:
    """(1 − η)·τ + η·rank score, η clipped to [0, 1]."""
    eta = min(max(float(eta), 0.0), 1.0)
    return (1.0 - eta) * col(tau) + eta * col(rank_score)


def r(c: Column | str, digits: int = 6) -> Column:
    """Round for reporting and cross-engine comparison; −0.0 becomes 0.0."""
    return F.round(col(c), digits) + F.lit(0.0)
