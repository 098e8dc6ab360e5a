"""Distillation of an uplift model into readable targeting rules.

* ``teacher_scores``: out-of-fold τ̂ and ψ inside the overlap band, with a
  calibrated propensity.
* ``student_tree``: a single tree of the teacher's τ̂; depth and leaf size are
  chosen by an out-of-fold composite score (0.6·nAUUC ratio + 0.3·max(0,
  Spearman) + 0.1·policy ratio), then it is refitted on all rows.
* ``extract_rules``: its leaves — at most 2^depth — as rules:
  ``leaf, value, conditions ARRAY<STRUCT<feature, op, threshold>>, rule_text``.
* ``apply_rules``: first-match leaf per row from the rules table (one CASE
  expression, no join).
* ``rule_values`` / ``rule_bootstrap``: per-leaf valuation and a Poisson
  bootstrap interval (replicate weights from md5, one grouped pass).
* ``distill_quality``: R², RMSE, Spearman, nAUUC of teacher/student, policy
  ratios and the pass rule.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.config import EffectConfig
from causeway.functions.hashing import md5_int
from causeway.operators import hte, ranking, robust, trees
from causeway.operators.clean import banded
from causeway.operators.joins import attach, join_null_safe, settle
from causeway.operators.nuisance.calibrate import calibrate
from causeway.operators.nuisance.forest import forest_nuisance
from causeway.operators.order import exact_quantiles

# Composite score weights, policy-ratio cap and pass thresholds.
W_NAUUC, W_RHO, W_POLICY = 0.6, 0.3, 0.1
POLICY_RATIO_CAP = 1.2
PASS_NAUUC_RATIO, PASS_RHO, PASS_POLICY = 0.70, 0.60, 0.85
BOOT_REPS = 200


# ------------------------------------------------------------ rules as data
def apply_rules(df: DataFrame, rules: Sequence[dict], out: str = "leaf") -> DataFrame:
    """First rule whose conditions all hold gives the row's leaf id.  A missing
    value lies below every threshold."""
    expr = None
    for rule in rules:
        cond = F.lit(True)
        for c in rule["conditions"]:
            x = F.col(c["feature"]).cast("double")
            thr = float(c["threshold"])
            op = c["op"]
            cond = cond & {"<=": x.isNull() | (x <= thr), ">": x > thr, "<": x.isNull() | (x < thr), ">=": x >= thr,
                           "==": x == thr, "!=": x != thr}[op]
        expr = F.when(cond, F.lit(int(rule["leaf"]))) if expr is None else \
            expr.when(cond, F.lit(int(rule["leaf"])))
    return df.withColumn(out, expr if expr is not None else F.lit(None).cast("int"))


def rule_text(conditions: Sequence[dict]) -> str:
    return " AND ".join(f"{c['feature']} {c['op']} {c['threshold']:g}" for c in conditions) or "TRUE"


def rules_frame(spark, rules: Sequence[dict]) -> DataFrame:
    rows = [(int(r["leaf"]), float(r["value"]) if r.get("value") is not None else None,
             [(c["feature"], c["op"], float(c["threshold"])) for c in r["conditions"]],
             rule_text(r["conditions"])) for r in rules]
    return spark.createDataFrame(rows, "leaf int, value double, "
                                       "conditions array<struct<feature:string,op:string,threshold:double>>, "
                                       "rule_text string")


def rule_values(df: DataFrame, leaf: str = "leaf", tau: str = "tau", psi: str = "psi") -> DataFrame:
    """n, coverage, mean τ̂ and Σψ per leaf (empty leaves do not appear),
    ordered by value, then uplift, then coverage, descending."""
    per = df.where(F.col(leaf).isNotNull()).groupBy(leaf).agg(
        F.count(F.lit(1)).alias("n"), F.avg(tau).alias("uplift"), F.sum(psi).alias("value"))
    tot = df.agg(F.count(F.lit(1)).alias("_tot"))
    per = attach(per, tot, [])
    return per.select(leaf, "n", (F.col("n") / F.col("_tot")).alias("coverage"), "uplift", "value") \
        .orderBy(F.col("value").desc(), F.col("uplift").desc(), F.col("coverage").desc())


def poisson_cdf(kmax: int = 10) -> list[float]:
    """P(K ≤ k) of a Poisson(1) variable, k = 0..kmax−1."""
    out, cdf, p = [], 0.0, math.exp(-1.0)
    for i in range(kmax):
        cdf += p
        out.append(cdf)
        p = p / (i + 1)
    return out


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw from a uniform by inverse CDF (exact for k ≤ 9)."""
    k = F.lit(0)
    for cdf in poisson_cdf():
        k = k + F.when(u > F.lit(cdf), 1).otherwise(0)
    return k


def replicate_uniform(id_col: str, rep: Column, reps: int, salt: str) -> Column:
    """Uniform in [0, 1) per (row, replicate): one md5 per row, then the
    per-replicate affine key of the permutation operator."""
    consts = robust.key_constants(0, salt)
    return robust.run_key(md5_int(id_col, salt), rep, consts) / F.lit(float(2 ** 62))


def rule_bootstrap(df: DataFrame, leaf: str = "leaf", tau: str = "tau", reps: int = BOOT_REPS,
                   salt: str = "boot") -> DataFrame:
    """90 % Poisson-bootstrap interval of each leaf's mean τ̂.

    Each row carries an md5-derived Poisson(1) weight per replicate; the
    weighted means per (leaf, replicate) come from one grouped pass (rows ×
    replicates are generated in the scan stage and partially aggregated),
    and their 5th/95th percentiles are exact."""
    rows = df.where(F.col(leaf).isNotNull()).select("id", leaf, tau)
    rep = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    rep = rep.withColumn("_w", poisson_weight(replicate_uniform("id", F.col("rep"), reps, salt)))
    means = rep.groupBy(leaf, "rep").agg(F.try_divide(F.sum(F.col("_w") * F.col(tau)), F.sum("_w")).alias("m"))
    q = exact_quantiles(means.where(F.col("m").isNotNull()), "m", [0.05, 0.95], [leaf])
    return q.groupBy(leaf).agg(F.max(F.when(F.col("p") < 0.5, F.col("q"))).alias("lo90"),
                               F.max(F.when(F.col("p") > 0.5, F.col("q"))).alias("hi90"))


# ------------------------------------------------------------ the student
def extract_rules(forest: trees.Forest) -> list[dict]:
    """One rule per leaf of a single tree (at most 2^depth)."""
    rules = forest.rules()
    for r in rules:
        r["rule_text"] = rule_text(r["conditions"])
    return rules


def composite_table(df: DataFrame, teacher: str, student: str, psi: str = "psi",
                    ks: Sequence[float] = (0.1, 0.2, 0.3), group: Sequence[str] = ()) -> DataFrame:
    """Student against teacher, a row per group: nAUUC of both and their ratio,
    Spearman, the policy ratio (over all k the mean of student / teacher, between
    0 and ``POLICY_RATIO_CAP``, 0 where the teacher's value is 0), the composite
    score, the pass rule and the policy values ``policy_teacher_<k>``,
    ``policy_student_<k>``.  One plan, nothing is read back."""
    group = list(group)
    areas = ranking.auuc_areas(df, [teacher, student, psi], psi, group, centered=True)
    oracle = F.col(f"area_{psi}")

    def normalised(score: str) -> Column:
        return F.when(F.abs(oracle) < 1e-12, F.lit(0.0)).otherwise(
            F.least(F.greatest(F.col(f"area_{score}") / oracle, F.lit(0.0)), F.lit(1.0)))

    top = areas.select(*group, "n", normalised(teacher).alias("nauuc_teacher"), normalised(student).alias("nauuc_student"))
    rho = ranking.spearman(df, teacher, student, group).select(*group, "spearman")
    pol = ranking.policy_table(df, [teacher, student], psi, ks, group)
    pct = [int(round(100 * k)) for k in ks]
    wide = pol.groupBy(*group).agg(*[
        F.max(F.when((F.col("score") == s) & (F.col("k_pct") == k), F.col("policy_value"))).alias(f"policy_{name}_{k}")
        for name, s in (("teacher", teacher), ("student", student)) for k in pct])
    if group:
        j = join_null_safe(join_null_safe(top, rho, group, how="left"), wide, group, how="left")
    else:
        j = top.crossJoin(F.broadcast(rho)).crossJoin(F.broadcast(wide))   # one row each
    ratios = [F.when(F.abs(F.col(f"policy_teacher_{k}")) < 1e-12, F.lit(0.0)).otherwise(F.least(F.greatest(
        F.col(f"policy_student_{k}") / F.col(f"policy_teacher_{k}"), F.lit(0.0)), F.lit(POLICY_RATIO_CAP))) for k in pct]
    sp = F.coalesce(F.nanvl("spearman", F.lit(0.0)), F.lit(0.0))
    j = (j.withColumn("spearman", sp)
         .withColumn("nauuc_ratio", F.when(F.col("nauuc_teacher") <= 1e-12, F.lit(0.0))
                     .otherwise(F.col("nauuc_student") / F.col("nauuc_teacher")))
         .withColumn("policy_ratio", sum(ratios, F.lit(0.0)) / len(ratios)))
    passed = (F.col("nauuc_ratio") >= PASS_NAUUC_RATIO) & (F.col("spearman") >= PASS_RHO)
    for k in pct:
        passed = passed & (F.col(f"policy_student_{k}") >= PASS_POLICY * F.col(f"policy_teacher_{k}"))
    score = W_NAUUC * F.col("nauuc_ratio") + W_RHO * F.greatest(F.lit(0.0), F.col("spearman")) + W_POLICY * F.col("policy_ratio")
    return j.withColumn("score", score).withColumn("passed", passed)


def student_tree(df: DataFrame, features: Sequence[str], teacher: str = "tau", psi: str = "psi",
                 depths: Sequence[int] = (2, 3, 4, 5, 6), leaf_shares: Sequence[float] = (0.01, 0.03, 0.08),
                 min_leaf: int = 20, fold: str = "fold", seed: int = 42) -> tuple[trees.Forest, DataFrame]:
    """The best single tree by the out-of-fold composite score, refitted on all
    rows, and the table of candidates (depth, leaf_share, score, …, best).

    A greedy tree cut at depth d is the greedy tree of depth d, so each leaf
    share needs one growth for all folds and depths; all depths are scored in
    one plan, as groups.  Every share is searched, however good an earlier one."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    n = df.count()
    cuts = trees.feature_cuts(df, features)
    table = []
    for share in leaf_shares:
        least = max(min_leaf, int(share * n))
        forest = trees.grow(df, features, [trees.Family("_student", F.col(teacher))], folds, fold, depth=max(depths),
                            min_leaf=least, seed=seed, cuts=cuts)
        scored = trees.predict(df.select("id", fold, teacher, psi, *dict.fromkeys(features)), forest, fold, depths=depths)
        stacked = settle(scored.select("id", teacher, psi, F.explode(F.array(*[
            F.struct(F.lit(d).alias("depth"), F.col(f"_student_{d}").alias("_student")) for d in depths])).alias("_c"))
            .select("id", teacher, psi, "_c.*"))
        for r in composite_table(stacked, teacher, "_student", psi, group=["depth"]).collect():   # a row per depth
            table.append({"depth": r["depth"], "leaf_share": float(share), "min_leaf": least, "score": r["score"],
                          "nauuc_ratio": r["nauuc_ratio"], "spearman": r["spearman"], "policy_ratio": r["policy_ratio"]})
    best = max(table, key=lambda r: (r["score"], -r["depth"]))
    for r in table:
        r["best"] = r is best
    model = trees.grow(df, features, [trees.Family("_student", F.col(teacher))], depth=best["depth"], min_leaf=best["min_leaf"],
                       seed=seed, cuts=cuts)
    return model, df.sparkSession.createDataFrame(table)


def distill_quality(df: DataFrame, teacher: str, student: str, psi: str = "psi") -> DataFrame:
    """R², RMSE of the student against the teacher, and the ranking metrics (one row)."""
    gap = F.col(teacher) - F.col(student)
    err = df.agg(F.avg(gap * gap).alias("mse"), F.var_pop(F.when(gap.isNotNull(), F.col(teacher))).alias("_v"))
    fit = err.select((1 - F.try_divide("mse", "_v")).alias("r2"), F.sqrt("mse").alias("rmse"))
    return fit.crossJoin(F.broadcast(composite_table(df, teacher, student, psi)))


def teacher_scores(panel: DataFrame, features: Sequence[str], cfg: EffectConfig, folds: Sequence[int],
                   band: tuple[float, float] = (0.2, 0.8), calibrated: bool = True, fold: str = "fold", **kw) -> DataFrame:
    """Out-of-fold τ̂ and ψ of the rows inside the overlap band (its fallbacks
    applied): forest nuisances, the propensity calibrated by a sigmoid, then a
    forest of ψ trained on the band's rows of the other folds."""
    nuis = settle(forest_nuisance(panel, features, cfg, folds, fold, **kw))
    if calibrated:
        nuis = settle(calibrate(nuis, cfg, folds, "sigmoid", fold))
    inside = banded(nuis, band, len(folds))
    return hte.dr_forest(inside, features, None, fold)
