"""causeway — causal evaluation of campaigns, expressed as Spark DataFrame plans.

Layout
------
sources/    panels built from raw tables, file readers, result sinks
functions/  column expressions (hash keys, clipping, pseudo-outcomes, labels)
operators/  folds, ordering, nuisance learners, estimators, diagnostics,
            robustness checks, ranking metrics, features, HTE, distillation
plans/      end-to-end campaign analysis and the named query catalogue
streaming/  incremental campaign batches over a file stream
"""

from causeway.config import EffectConfig, Rules

__all__ = ["EffectConfig", "Rules"]
