"""End-to-end campaign analysis (one call → result record + per-user uplift).

Steps, all keyed by ``activity_id`` so many campaigns run in the same job:

1. folds and strata nuisances on the whole panel (persisted once — every
   later step reads this table);
2. ATE with its permutation placebo p-value;
3. overlap band on the ATE run's propensity → treated kept/total, and the
   ATT re-estimated inside the band (new cross-fit) with its placebo;
4. τ̂ from the cross-fitted segment DR learner, trained inside the HTE band (with
   its fallbacks) and given to all rows, its quantiles over all rows and inside
   the band;
5. a one-row-per-activity result (flat, or nested as the record struct) and
   the treated rows' uplift table;
6. the diagnosis of each activity: overlap, balance, placebo and the verdict,
   and the ranking quality of τ̂ inside the band behind its validity gate.

``full_campaign`` puts the learned chain in front: features, a tuner, forest
nuisances and a forest τ̂.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.config import EffectConfig, Rules
from causeway.functions import schema
from causeway.functions.scalar import r
from causeway.operators import diagnose, estimate, hte, ranking, robust, tune
from causeway.operators import trees as trees_mod
from causeway.operators.clean import band_choice, banded, gated
from causeway.operators.features.factory import FeatureFactory
from causeway.operators.folds import assign_folds
from causeway.operators.joins import attach, join_null_safe, keep, settle
from causeway.operators.nuisance.calibrate import calibrate
from causeway.operators.nuisance.forest import forest_nuisance
from causeway.operators.nuisance.strata import strata_nuisance
from causeway.operators.order import exact_quantiles

# The campaign analysis defaults.
CAMPAIGN_CFG = EffectConfig(n_splits=3, trim=0.01, ps_clip=(0.05, 0.95), weight_clip=10.0, seed=2025,
                            rules=Rules(smd_max=0.3, ovl_min=0.50, ks_max=0.60, ess_min=0.70,
                                        placebo_alpha=0.09, nc_alpha=0.10, top_k_smd=8))
QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


@dataclass(frozen=True)
class CampaignSpec:
    activity_id: str | None = None        # constant id for a single campaign
    created_at: str = "1970-01-01T00:00:00Z"
    t_col: str = "t"
    y_col: str = "y"
    att_band: tuple[float, float] = (0.2, 0.8)
    hte_band: tuple[float, float] = (0.2, 0.8)
    ate_runs: int = 5
    att_runs: int = 10
    y_scale: int | None = 2
    cfg: EffectConfig = field(default_factory=lambda: CAMPAIGN_CFG)


def _effect_with_placebo(panel: DataFrame, cell: Column, spec: CampaignSpec, estimand: str,
                         runs: int, group: list[str]) -> tuple[DataFrame, DataFrame]:
    nuis = settle(strata_nuisance(panel, cell, spec.cfg, group, y_scale=spec.y_scale))
    eff = estimate.effect_table(nuis, estimand, spec.cfg, group)
    plac = robust.placebo_runs(panel, cell, spec.cfg, runs, ("y",), group, y_scale=spec.y_scale)
    p = robust.permutation_pvalue(plac, eff, estimand, group).select(*group, "p_value")
    return nuis, attach(eff, p, group)


@dataclass(frozen=True)
class CampaignParts:
    """The tables a campaign's results are read from."""

    nuis: DataFrame         # rows with nuisances and ψ
    tau: DataFrame          # the same with τ̂
    ate: DataFrame          # effect and placebo p-value per activity
    att: DataFrame          # the same inside the band
    kept: DataFrame         # treated rows kept by the band


def campaign_parts(panel: DataFrame, cell: Column, spec: CampaignSpec = CampaignSpec(),
                   group: Sequence[str] = ("activity_id",)) -> CampaignParts:
    cfg = spec.cfg
    base = panel
    if spec.activity_id is not None or "activity_id" not in panel.columns:
        base = base.withColumn("activity_id", F.lit(spec.activity_id or "activity"))
    group = list(group)
    base = settle(assign_folds(base, cfg.n_splits, cfg.seed))

    nuis, ate = _effect_with_placebo(base, cell, spec, "ATE", spec.ate_runs, group)
    lo, hi = spec.att_band
    in_att = F.col("e").between(lo, hi)
    kept = nuis.groupBy(*group).agg(
        F.count(F.when(in_att & (F.col("t") == 1), 1)).alias("treated_kept"),
        F.count(F.when(F.col("t") == 1, 1)).alias("treated_total"))
    band_panel = nuis.where(in_att).select(*base.columns)
    _, att = _effect_with_placebo(band_panel, cell, spec, "ATT", spec.att_runs, group)

    choice = band_choice(nuis, spec.hte_band, cfg.n_splits, group=group).select(
        *group, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    inside = F.col("e").between(F.col("_lo"), F.col("_hi"))
    tau = settle(hte.dr_segment(attach(nuis, choice, group), cell, group, train=inside).drop("_lo", "_hi"))
    return CampaignParts(nuis, tau, ate, att, kept)


def campaign_analysis(panel: DataFrame, cell: Column, spec: CampaignSpec = CampaignSpec(),
                      group: Sequence[str] = ("activity_id",)) -> tuple[DataFrame, DataFrame]:
    """Returns ``(result, user_uplift)``; ``panel`` has id, t, y and the
    covariates the cell expression reads (plus the group column)."""
    return campaign_result(campaign_parts(panel, cell, spec, group), spec, group)


def campaign_result(parts: CampaignParts, spec: CampaignSpec = CampaignSpec(),
                    group: Sequence[str] = ("activity_id",)) -> tuple[DataFrame, DataFrame]:
    group = list(group)
    tau, ate, att, kept = parts.tau, parts.ate, parts.att, parts.kept
    qf = exact_quantiles(tau, "tau", QUANTILES, group)
    hb_lo, hb_hi = spec.hte_band
    qb = exact_quantiles(tau.where(F.col("e").between(hb_lo, hb_hi)), "tau", QUANTILES, group)

    def wide(q: DataFrame, prefix: str) -> DataFrame:
        return q.groupBy(*group).agg(*[F.max(F.when(F.abs(F.col("p") - p) < 1e-9, F.col("q")))
                                       .alias(f"{prefix}p{int(round(p * 100))}") for p in QUANTILES])

    a = ate.select(*group, F.col("n").alias("n_samples"), "n_treated", "n_control",
                   F.col("est").alias("ate_point"), F.col("se").alias("ate_se"),
                   F.col("ci_lo").alias("ate_ci_lo"), F.col("ci_hi").alias("ate_ci_hi"),
                   F.col("p_value").alias("ate_placebo_p"))
    t = att.select(*group, F.col("est").alias("att_point"), F.col("se").alias("att_se"),
                   F.col("ci_lo").alias("att_ci_lo"), F.col("ci_hi").alias("att_ci_hi"),
                   F.col("p_value").alias("att_placebo_p"))
    res = a
    for part in (t, kept, wide(qf, "tau_"), wide(qb, "tau_band_")):
        res = join_null_safe(res, part, group, how="left")
    res = res.withColumn("treated_coverage", F.when(F.col("treated_total") > 0,
                                                    F.col("treated_kept") / F.col("treated_total")))
    res = res.withColumn("created_at", F.lit(spec.created_at)) \
             .withColumn("t_col", F.lit(spec.t_col)).withColumn("y_col", F.lit(spec.y_col))

    uplift = tau.where(F.col("t") == 1).select(
        F.col("activity_id").alias("activity_uuid"), F.col("id").alias("identity"),
        F.col("t").alias("t_col"), F.lit(spec.y_col).alias("y_col"),
        F.lit(spec.created_at).alias("created_at"), F.col("tau").alias("tau_hat"), "psi")
    return res, uplift


def campaign_diagnosis(parts: CampaignParts, features: Sequence[str], spec: CampaignSpec = CampaignSpec(),
                       group: Sequence[str] = ("activity_id",), ks: Sequence[float] = (0.1, 0.2, 0.3)) -> DataFrame:
    """Per activity: overlap (OVL, KS), the largest |SMD|, the placebo p-value,
    the credibility flags and verdict, and the ranking of τ̂ inside the HTE band —
    nAUUC and policy values, NULL with a ``note`` where the band is too small or
    one-armed or too few rows have both scores."""
    group, cfg = list(group), spec.cfg
    ovl = diagnose.ovl_coefficient(parts.nuis, group)
    ks_table = diagnose.ks_statistic(parts.nuis, group).select(*group, "ks")
    smd = diagnose.smd_max(diagnose.smd_table(parts.nuis, features, "ATE", cfg, group), group)
    row = parts.ate.select(*group, "n", F.col("p_value").alias("placebo_p"))
    for part in (ovl, ks_table, smd):
        row = join_null_safe(row, part, group, how="left")
    flags = robust.verdict(F.col("ovl"), F.col("ks"), F.col("smd_max"), F.col("placebo_p"), None, cfg.rules)
    row = row.select("*", *flags)

    choice = band_choice(parts.nuis, spec.hte_band, cfg.n_splits, group=group).select(
        *group, "n_band", F.try_divide(F.col("n_band"), F.col("n")).alias("band_coverage"), F.col("note").alias("band_note"))
    inside = settle(parts.tau.where(F.col("e").between(*spec.hte_band)))
    ranked = ranking.nauuc(inside, "tau", group=group).select(*group, "nauuc")
    pol = ranking.policy_table(inside, ["tau"], "psi", ks, group)
    wide = pol.groupBy(*group).agg(*[F.max(F.when(F.col("k_pct") == round(100 * k), F.col("policy_value")))
                                     .alias(f"policy_{round(100 * k)}") for k in ks])
    ranked = gated(join_null_safe(ranked, wide, group, how="left"), inside, cfg.n_splits, group=group)
    row = join_null_safe(join_null_safe(row, choice, group, how="left"), ranked, group, how="left")
    fine = F.col("band_note").isNull()
    shown = ["nauuc", *[f"policy_{round(100 * k)}" for k in ks]]
    return row.select(*group, "n", "ovl", "ks", "smd_max", "placebo_p", "overlap_pass", "balance_pass", "placebo_pass",
                      "negctrl_pass", "n_pass", "verdict", "n_band", "band_coverage",
                      *[F.when(fine, F.col(c)).alias(c) for c in shown],
                      F.coalesce("band_note", "note").alias("note"))


def flat_record(records: DataFrame) -> DataFrame:
    """The nested record as plain columns, rounded as the flat result is."""
    q = (10, 25, 50, 75, 90)
    money = [F.col("ate_point"), *[F.col("ate_ci")[i].alias(f"ate_ci_{s}") for i, s in enumerate(("lo", "hi"))],
             F.col("att_point"), *[F.col("att_ci")[i].alias(f"att_ci_{s}") for i, s in enumerate(("lo", "hi"))],
             *[F.col(f"tau_quantiles_full.p{p}").alias(f"tau_p{p}") for p in q],
             *[F.col("tau_quantiles_band")[i].alias(f"tau_band_p{p}") for i, p in enumerate(q)]]
    report = [F.get_json_object(f"{e}_report", f"$.{e}_{c}").cast("double").alias(f"{e}_{c}")
              for e in ("ate", "att") for c in ("se", "placebo_p")]
    flat = records.select("activity_uuid", "created_at", "t_col", "y_col", "n_samples", "n_treated", "n_control", *money, *report,
                          F.col("overlap_band_for_att.range")[0].alias("att_band_lo"),
                          F.col("overlap_band_for_hte.range")[1].alias("hte_band_hi"),
                          *[F.col(f"overlap_band_for_att.{c}").alias(c) for c in ("treated_kept", "treated_total", "treated_coverage")])
    digits = {"treated_coverage": 6, "ate_placebo_p": 6, "att_placebo_p": 6}
    return flat.select(*[r(c, digits.get(c, 4)).alias(c) if t == "double" else F.col(c) for c, t in flat.dtypes])


def full_campaign(panel: DataFrame, cat_cols: Sequence[str] | None, num_cols: Sequence[str], group_keys: Sequence[Sequence[str]] = (),
                  spec: CampaignSpec = CampaignSpec(), trials: int = 30, max_cols: int = 30,
                  trees: int = 100) -> tuple[DataFrame, DataFrame]:
    """The learned campaign of one activity: features (no target is used; without
    ``cat_cols`` the text columns are the categories), a tuner of the nuisance forests, ATE on all rows and ATT in the band with their
    diagnosis, τ̂ by a forest trained in the band and given to all rows.  Returns
    (one result row, rows with τ̂)."""
    cfg = spec.cfg
    base = settle(assign_folds(panel, cfg.n_splits, cfg.seed))
    folds = list(range(cfg.n_splits))
    cats = schema.existing_columns(base, cat_cols) if cat_cols is not None else [
        c for c in schema.category_columns(base) if c not in ("id", "activity_id")]
    factory = FeatureFactory(cat_cols=cats, num_cols=schema.existing_columns(base, num_cols), group_keys=[list(g) for g in group_keys],
                             target_encoding=False, quantile_bins=12, pca=min(12, len(num_cols)), max_total_cols=max_cols)
    deep = factory.fit_transform(base)
    features = factory.feature_columns(deep, base)
    rows = settle(deep.select("id", "t", "y", "fold", *features))
    factory.release()
    params = tune.best_params(tune.tune(rows, features, cfg, folds, "nauuc_ci", trials, band=spec.hte_band))
    shape = {"trees": params["trees"], "depth": params["depth"], "min_leaf": params["min_leaf"],
             "mtry": max(1, round(params["feature_share"] * len(features)))}

    def effect(part: DataFrame, estimand: str) -> tuple[DataFrame, DataFrame]:
        nuis = forest_nuisance(part, features, cfg, folds, **shape)
        if params["calibration"] != "none":
            nuis = calibrate(settle(nuis), cfg, folds, params["calibration"])
        nuis = settle(nuis)
        return nuis, estimate.effect_table(nuis, estimand, cfg)

    nuis, ate = effect(rows, "ATE")
    inside = nuis.where(F.col("e").between(*spec.att_band)).select(*rows.columns)
    _, att = effect(inside, "ATT")
    in_band = banded(nuis, spec.hte_band, cfg.n_splits)
    forest = trees_mod.grow(in_band, features, [trees_mod.Family("tau", F.col("psi"))], folds, depth=params["depth"], trees=trees,
                            min_leaf=params["min_leaf"], mtry=shape["mtry"])
    tau = settle(trees_mod.predict(nuis, forest))
    one = F.lit(spec.activity_id or "activity").alias("activity_id")
    tagged = ate.select("*", F.lit(None).cast("double").alias("p_value"))
    parts = CampaignParts(*(d.select(one, "*") for d in (nuis, tau, tagged, att, nuis.groupBy().agg(F.count(F.lit(1)).alias("n")))))
    found = campaign_diagnosis(parts, features, spec).drop("placebo_p", "placebo_pass", "n_pass", "verdict", "n")
    q = exact_quantiles(tau, "tau", QUANTILES).agg(*[F.max(F.when(F.abs(F.col("p") - p) < 1e-9, F.col("q")))
                                                     .alias(f"tau_p{round(100 * p)}") for p in QUANTILES])
    row = (ate.select("n", "n_treated", "n_control", *[F.col(c).alias(f"ate_{c}") for c in ("est", "se", "ci_lo", "ci_hi")])
           .crossJoin(F.broadcast(att.select(*[F.col(c).alias(f"att_{c}") for c in ("est", "se", "ci_lo", "ci_hi")])))
           .crossJoin(F.broadcast(q)).crossJoin(F.broadcast(found)))       # one row each
    first = row.select("activity_id", *[c for c in row.columns if c != "activity_id"], F.lit(len(features)).alias("n_features"))
    return first, tau.select("id", "t", "fold", "e", "psi", "tau")


def result_record(res: DataFrame, spec: CampaignSpec = CampaignSpec()) -> DataFrame:
    """The nested result record (arrays, structs) of each activity."""
    q = ["p10", "p25", "p50", "p75", "p90"]
    return res.select(
        F.col("activity_id").alias("activity_uuid"), "created_at", "t_col", "y_col",
        F.col("n_samples").cast("int").alias("n_samples"), F.col("n_treated").cast("int").alias("n_treated"),
        F.col("n_control").cast("int").alias("n_control"), "ate_point",
        F.array("ate_ci_lo", "ate_ci_hi").alias("ate_ci"), "att_point",
        F.array("att_ci_lo", "att_ci_hi").alias("att_ci"),
        *[F.to_json(F.struct("n_samples", "n_treated", "n_control", *[f"{e}_{c}" for c in ("point", "se", "ci_lo", "ci_hi", "placebo_p")]))
          .alias(f"{e}_report") for e in ("ate", "att")],
        F.to_json(F.struct(*[f"tau_{p}" for p in q])).alias("hte_report"),
        F.struct(*[F.col(f"tau_{p}").alias(p) for p in q]).alias("tau_quantiles_full"),
        F.array(*[f"tau_band_{p}" for p in q]).alias("tau_quantiles_band"),
        F.struct(F.array(F.lit(spec.att_band[0]), F.lit(spec.att_band[1])).alias("range"),
                 F.col("treated_kept").cast("int").alias("treated_kept"),
                 F.col("treated_total").cast("int").alias("treated_total"),
                 F.col("treated_coverage").alias("treated_coverage")).alias("overlap_band_for_att"),
        F.struct(F.array(F.lit(spec.hte_band[0]), F.lit(spec.hte_band[1])).alias("range"))
        .alias("overlap_band_for_hte"))


def rounded_result(res: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    money = ["ate_point", "ate_se", "ate_ci_lo", "ate_ci_hi", "att_point", "att_se", "att_ci_lo",
             "att_ci_hi"] + [f"tau_{p}" for p in ("p10", "p25", "p50", "p75", "p90")] \
        + [f"tau_band_{p}" for p in ("p10", "p25", "p50", "p75", "p90")]
    ratios = ["ate_placebo_p", "att_placebo_p", "treated_coverage"]
    return res.select(*group, "n_samples", "n_treated", "n_control", "treated_kept", "treated_total",
                      *[r(c, 4).alias(c) for c in money], *[r(c, 6).alias(c) for c in ratios])
