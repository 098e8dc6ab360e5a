"""Parameters of the estimators and of the go/no-go rules."""

from __future__ import annotations

from dataclasses import dataclass, field

# Defaults of the estimator and of the credibility rules.
Z975 = 1.959963984540054  # normal quantile at 0.975
Z_TUNER = 1.96  # rounded z used by the tuner's CI-width objective
EPS = 1e-12  # denominator guard used throughout the weighting formulas
OVL_BINS = 50  # histogram bins of the overlap coefficient on [0, 1]
TE_SMOOTHING = 20.0  # target-encoding smoothing strength
NA_LEVEL = "__NA__"  # level that stands for a missing category


@dataclass(frozen=True)
class Rules:
    """Thresholds of the credibility verdict (fixed defaults)."""

    smd_max: float = 0.10
    ovl_min: float = 0.50
    ks_max: float = 0.40
    ess_min: float = 0.70
    placebo_alpha: float = 0.10
    nc_alpha: float = 0.10
    top_k_smd: int = 10


@dataclass(frozen=True)
class EffectConfig:
    """Cross-fitting and clipping parameters.

    ``trim`` clips the out-of-fold propensity inside the fold fit, ``ps_clip``
    clips it again before the pseudo-outcome; ``weight_clip`` caps the
    diagnostic weights (and the ATO weight, which enters the estimate).
    """

    n_splits: int = 5
    trim: float = 0.01
    ps_clip: tuple[float, float] | None = (0.01, 0.99)
    weight_clip: float | None = None
    seed: int = 42
    rules: Rules = field(default_factory=Rules)
