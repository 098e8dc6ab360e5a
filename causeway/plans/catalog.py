"""Named queries: one per operator of the inventory, each a function
``(spark, sf_dir) -> DataFrame`` over the given tables.

Output columns are aliased to the names the SQL twins use.  Values that are
order-dependent aggregates are rounded (money to 4, ratios to 6 decimals);
row-level values computed by the same arithmetic in any engine are not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.scalar import r
from causeway.operators import estimate
from causeway.operators.nuisance.strata import strata_nuisance
from causeway.operators.order import exact_quantiles, ordered
from causeway.plans.common import DEFAULT, customer_folds, customer_nuisance, order_nuisance
from causeway.sources.panels import panel_customer, panel_orders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _effect_row(df: DataFrame) -> DataFrame:
    return df.select("n", "n_treated", "n_control", r("est", 4).alias("est"),
                     r("se", 4).alias("se"), r("ci_lo", 4).alias("ci_lo"),
                     r("ci_hi", 4).alias("ci_hi"))


# ---------------------------------------------------------------- P0 panels
@query("panel_customer")
def q_panel_customer(spark, sf_dir):
    return panel_customer(spark, sf_dir)


@query("panel_orders")
def q_panel_orders(spark, sf_dir):
    return panel_orders(spark, sf_dir).drop("order_date")


@query("fold_assign")
def q_fold_assign(spark, sf_dir):
    return customer_folds(spark, sf_dir).groupBy("fold", "t").agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum"))


# ---------------------------------------------------------------- P1 effects
@query("nuisance_strata")
def q_nuisance_strata(spark, sf_dir):
    return customer_nuisance(spark, sf_dir).select("id", "fold", "cell", "e_raw", "e", "mu1",
                                                   "mu0", "psi")


@query("ate_aipw_strata")
def q_ate(spark, sf_dir):
    return _effect_row(estimate.effect_table(customer_nuisance(spark, sf_dir), "ATE", DEFAULT))


@query("att_strata")
def q_att(spark, sf_dir):
    return _effect_row(estimate.effect_table(customer_nuisance(spark, sf_dir), "ATT", DEFAULT))


@query("ato_strata")
def q_ato(spark, sf_dir):
    return _effect_row(estimate.effect_table(customer_nuisance(spark, sf_dir), "ATO", DEFAULT))


@query("ate_orders_strata")
def q_ate_orders(spark, sf_dir):
    return _effect_row(estimate.effect_table(order_nuisance(spark, sf_dir), "ATE", DEFAULT))


@query("naive_diff")
def q_naive(spark, sf_dir):
    d = estimate.naive_difference(panel_customer(spark, sf_dir))
    return d.select(r("mean_treated", 4).alias("mean_treated"),
                    r("mean_control", 4).alias("mean_control"),
                    r("naive_diff", 4).alias("naive_diff"))


@query("ci_width_norm")
def q_ci_width(spark, sf_dir):
    d = estimate.ci_width_normalised(customer_nuisance(spark, sf_dir))
    return d.select("n", r("ci_width", 4).alias("ci_width"),
                    r("ci_width_norm", 6).alias("ci_width_norm"))


@query("fold_variance")
def q_fold_var(spark, sf_dir):
    d = estimate.fold_variance(customer_nuisance(spark, sf_dir))
    return d.select("n_folds", r("fold_variance", 2).alias("fold_variance"))


# ------------------------------------------------------------ P2 diagnostics
from causeway.operators import diagnose  # noqa: E402
from causeway.operators.features.encode import one_hot  # noqa: E402
from causeway.operators.joins import attach, join_small, keep, settle  # noqa: E402

SEG_LEVELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
BALANCE_FEATURES = ("before_cnt", "before_amt", "acctbal", "region")


def customer_balance_frame(spark, sf_dir):
    """Customer nuisance table with one-hot market segments (first level dropped)."""
    nuis = customer_nuisance(spark, sf_dir)
    return one_hot(nuis, "seg", levels=SEG_LEVELS, drop_first=True, prefix="seg")


def balance_features() -> list[str]:
    return list(BALANCE_FEATURES) + [f"seg_{v}" for v in SEG_LEVELS[1:]]


@query("ks_overlap")
def q_ks(spark, sf_dir):
    return diagnose.ks_statistic(customer_nuisance(spark, sf_dir))


@query("ovl_overlap")
def q_ovl(spark, sf_dir):
    return diagnose.ovl_coefficient(customer_nuisance(spark, sf_dir)).select(r("ovl", 6).alias("ovl"))


@query("ess_ratio")
def q_ess(spark, sf_dir):
    nuis = customer_nuisance(spark, sf_dir)
    parts = [diagnose.ess_ratio(nuis, est, DEFAULT).select(F.lit(est).alias("estimand"),
                                                          r("ess_t", 6).alias("ess_t"),
                                                          r("ess_c", 6).alias("ess_c"))
             for est in estimate.ESTIMANDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("weight_tails")
def q_tails(spark, sf_dir):
    nuis = customer_nuisance(spark, sf_dir)
    parts = [diagnose.weight_tails(nuis, est, DEFAULT).select(
        F.lit(est).alias("estimand"), "arm", r("w_p99", 6).alias("w_p99"), r("w_max", 6).alias("w_max"))
        for est in estimate.ESTIMANDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _smd_query(estimand):
    def fn(spark, sf_dir):
        smd = diagnose.smd_table(customer_balance_frame(spark, sf_dir), balance_features(),
                                 estimand, DEFAULT)
        return smd.select("feature", r("smd", 6).alias("smd"))
    return fn


for _est in estimate.ESTIMANDS:
    QUERIES[f"smd_{_est.lower()}"] = _smd_query(_est)


@query("smd_topk")
def q_smd_top(spark, sf_dir):
    smd = diagnose.smd_table(customer_balance_frame(spark, sf_dir), balance_features(), "ATE", DEFAULT)
    top = diagnose.smd_top(smd, k=5)
    return top.select("rank", "feature", r("smd", 6).alias("smd"))


@query("band_coverage")
def q_band(spark, sf_dir):
    b = diagnose.band_coverage(customer_nuisance(spark, sf_dir), 0.3, 0.7)
    return b.select("n", "n_band", "n_band_treated", "n_band_control", r("coverage", 6).alias("coverage"))


@query("propensity_summary")
def q_ps(spark, sf_dir):
    s = diagnose.propensity_summary(customer_nuisance(spark, sf_dir))
    return s.select(r("e_mean", 6).alias("e_mean"), "e_min", "e_max")


# ------------------------------------------------------------ P3 ranking
from causeway.operators import hte, ranking  # noqa: E402
from causeway.operators.order import exact_quantiles  # noqa: E402


def customer_tau(spark, sf_dir):
    """Nuisance table + cross-fitted segment-mean τ̂ (segments = strata cells)."""
    return hte.dr_segment(customer_nuisance(spark, sf_dir), "cell")


@query("dr_segment")
def q_dr_segment(spark, sf_dir):
    return customer_tau(spark, sf_dir).select("id", "fold", r("tau", 4).alias("tau"))


@query("dr_segment_effects")
def q_seg_effects(spark, sf_dir):
    s = hte.segment_effects(customer_nuisance(spark, sf_dir), "cell")
    return s.select("segment", "n", *[r(c, 4).alias(c) for c in
                                       ("tau", "se", "lb90", "ub90", "lb95", "ub95", "lb99", "ub99")])


def _area_query(centered):
    def fn(spark, sf_dir):
        a = ranking.auuc_area(customer_tau(spark, sf_dir), "tau", centered=centered)
        return a.select("n", r("area", 2).alias("area"))
    return fn


QUERIES["area_centered"] = _area_query(True)
QUERIES["area_uncentered"] = _area_query(False)


@query("nauuc")
def q_nauuc(spark, sf_dir):
    a = ranking.nauuc(customer_tau(spark, sf_dir), "tau", centered=True, on_zero="null")
    return a.select("n", r("area_model", 2).alias("area_model"),
                    r("area_oracle", 2).alias("area_oracle"), r("nauuc", 6).alias("nauuc"))


@query("nauuc_foldmean")
def q_nauuc_fold(spark, sf_dir):
    per = ranking.nauuc(customer_tau(spark, sf_dir), "tau", group=["fold"], centered=False)
    return per.agg(F.count(F.lit(1)).alias("n_folds"), r(F.avg("nauuc"), 6).alias("nauuc_mean"))


@query("policy_at_k")
def q_policy(spark, sf_dir):
    p = ranking.policy_values(customer_tau(spark, sf_dir), "tau", ks=(0.1, 0.2, 0.3))
    return p.select("k_pct", "m", r("policy_value", 2).alias("policy_value"))


@query("gain_curve")
def q_gain(spark, sf_dir):
    g = ranking.gain_curve(customer_tau(spark, sf_dir), "tau", points=100)
    return g.select("q", "m", r("coverage", 6).alias("coverage"), r("gain", 2).alias("gain"))


@query("spearman")
def q_spearman(spark, sf_dir):
    s = ranking.spearman(customer_tau(spark, sf_dir), "tau", "psi")
    return s.select("n", r("spearman", 6).alias("spearman"))


@query("tau_quantiles")
def q_tau_q(spark, sf_dir):
    tau = customer_tau(spark, sf_dir).withColumn("tau", F.round("tau", 6))
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    full = exact_quantiles(tau, "tau", probs).select(F.lit("full").alias("scope"), "p", "q")
    band = exact_quantiles(tau.where(F.col("e").between(0.2, 0.8)), "tau", probs) \
        .select(F.lit("band").alias("scope"), "p", "q")
    return full.unionByName(band).select("scope", "p", r("q", 4).alias("q"))


@query("tau_psi_corr")
def q_tau_corr(spark, sf_dir):
    d = customer_tau(spark, sf_dir).where(F.col("e").between(0.3, 0.7))
    return d.agg(F.count(F.lit(1)).alias("n"), r(F.corr("tau", "psi"), 6).alias("corr"))


# ------------------------------------------------------------ P4 robustness
from causeway.operators import robust  # noqa: E402
from causeway.sources.panels import customer_cell  # noqa: E402

PLACEBO_RUNS = 100


def customer_placebo(spark, sf_dir, runs=PLACEBO_RUNS):
    panel = customer_folds(spark, sf_dir)
    return keep(robust.placebo_runs(panel, customer_cell(), DEFAULT, runs, outcomes=("y", "y_nc"),
                                    y_scale=2))


@query("placebo_strata")
def q_placebo(spark, sf_dir):
    runs = customer_placebo(spark, sf_dir).where(F.col("outcome") == "y")
    return runs.select("run", r("ate", 4).alias("ate"), r("att", 4).alias("att"), r("ato", 4).alias("ato"))


@query("placebo_pvalue")
def q_placebo_p(spark, sf_dir):
    obs = estimate.effect_table(customer_nuisance(spark, sf_dir), "ATE", DEFAULT)
    runs = customer_placebo(spark, sf_dir).where(F.col("outcome") == "y")
    p = robust.permutation_pvalue(runs, obs, "ATE")
    return p.select(r("est", 4).alias("est"), "runs", "n_extreme", r("p_value", 6).alias("p_value"))


@query("negctrl_strata")
def q_negctrl(spark, sf_dir):
    obs = estimate.effect_table(customer_nuisance(spark, sf_dir, y="y_nc"), "ATE", DEFAULT)
    runs = customer_placebo(spark, sf_dir).where(F.col("outcome") == "y_nc")
    p = robust.permutation_pvalue(runs, obs, "ATE")
    return p.select(r("est", 4).alias("est_nc"), "runs", "n_extreme", r("p_value", 6).alias("p_nc"))


@query("verdict_flags")
def q_verdict(spark, sf_dir):
    """Overlap, balance, placebo and negative control of one effect: every part is a
    one-row table, and both p-values come from the same placebo runs."""
    nuis = customer_nuisance(spark, sf_dir)
    runs = customer_placebo(spark, sf_dir)
    smd = diagnose.smd_table(one_hot(nuis, "seg", levels=SEG_LEVELS, drop_first=True, prefix="seg"), balance_features(), "ATE", DEFAULT)
    row = attach(attach(diagnose.ovl_coefficient(nuis), diagnose.ks_statistic(nuis).select("ks"), []), diagnose.smd_max(smd), [])
    for outcome, table, name in (("y", nuis, "placebo_p"), ("y_nc", customer_nuisance(spark, sf_dir, y="y_nc"), "negctrl_p")):
        p = robust.permutation_pvalue(runs.where(F.col("outcome") == outcome), estimate.effect_table(table, "ATE", DEFAULT), "ATE")
        row = attach(row, p.select(r("p_value", 6).alias(name)), [])
    flags = robust.verdict(F.col("ovl"), F.col("ks"), F.col("smd_max"), F.col("placebo_p"),
                           F.col("negctrl_p"), DEFAULT.rules)
    return row.select(r("ovl", 6).alias("ovl"), r("ks", 6).alias("ks"), r("smd_max", 6).alias("smd_max"),
                      "placebo_p", "negctrl_p", *flags)


# ------------------------------------------------------------ placebo on orders
@query("placebo_orders")
def q_placebo_orders(spark, sf_dir):
    from causeway.operators.folds import assign_folds
    from causeway.sources.panels import order_cell

    panel = assign_folds(panel_orders(spark, sf_dir), DEFAULT.n_splits, DEFAULT.seed)
    runs = robust.placebo_runs(panel, order_cell(), DEFAULT, PLACEBO_RUNS, y_scale=2)
    return runs.select("run", r("ate", 4).alias("ate"))


# ------------------------------------------------------------ P5 features
from causeway.functions.hashing import fold_of  # noqa: E402
from causeway.operators.features import derive, encode, groups, reduce  # noqa: E402
from causeway.sources.panels import labelled_documents  # noqa: E402

CAT_COLS = ["lang", "source"]
NUM_COLS = ["before_cnt", "before_amt", "acctbal", "y_nc"]


def _docs_folded(spark, sf_dir):
    return labelled_documents(spark, sf_dir).withColumn("fold", fold_of("id", DEFAULT.n_splits, DEFAULT.seed))


@query("te_oof")
def q_te_oof(spark, sf_dir):
    out, _ = encode.target_encode_oof(_docs_folded(spark, sf_dir), CAT_COLS, "quality", DEFAULT.n_splits)
    return out.select("id", *[r(f"{c}__te", 6).alias(f"{c}__te") for c in CAT_COLS])


@query("te_map")
def q_te_map(spark, sf_dir):
    _, te_map = encode.target_encode_oof(_docs_folded(spark, sf_dir), CAT_COLS, "quality", DEFAULT.n_splits)
    return te_map.select("col", "level", r("te", 6).alias("te"), "n_folds")


@query("count_freq")
def q_count_freq(spark, sf_dir):
    from causeway.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    out = encode.count_frequency(docs, CAT_COLS)
    return out.select(F.col("doc_id").alias("id"), *[c for c in out.columns if "__" in c])


@query("woe")
def q_woe(spark, sf_dir):
    t = encode.woe_table(labelled_documents(spark, sf_dir), CAT_COLS, "quality")
    return t.select("col", "level", "n1", "n0", r("woe", 6).alias("woe"))


@query("binary_target")
def q_binary(spark, sf_dir):
    d = labelled_documents(spark, sf_dir)
    return d.agg(F.count_distinct("quality").alias("n_distinct"), F.min("quality").alias("lo"),
                 F.max("quality").alias("hi")).withColumn(
        "is_binary", (F.col("n_distinct") <= 2) & F.col("lo").isin(0, 1) & F.col("hi").isin(0, 1))


GROUP_KEYS = [["seg"], ["region", "seg"]]
GROUP_NUMS = ["acctbal", "before_amt"]


@query("group_agg")
def q_group_agg(spark, sf_dir):
    out = groups.group_aggregates(panel_customer(spark, sf_dir), GROUP_KEYS, GROUP_NUMS)
    gcols = [c for c in out.columns if c.startswith("grp_")]
    return out.select("id", *[r(c, 4).alias(c) for c in gcols])


@query("num_derive")
def q_num_derive(spark, sf_dir):
    out = derive.numeric_derivatives(panel_customer(spark, sf_dir), NUM_COLS)
    dcols = [c for c in out.columns if "__" in c]
    # log1p may differ by an ulp between engines; products/quotients do not.
    return out.select("id", *[r(c, 6).alias(c) if c.endswith("__log1p") else F.col(c) for c in dcols])


@query("qbin")
def q_qbin(spark, sf_dir):
    out, _ = derive.quantile_bins(panel_customer(spark, sf_dir), ["acctbal", "before_amt"], q=10)
    return out.select("id", *[c for c in out.columns if "__qbin_" in c])


@query("poly2")
def q_poly2(spark, sf_dir):
    p = panel_customer(spark, sf_dir)
    return p.select("id", *derive.poly2_columns(["before_cnt", "before_amt", "acctbal"]))


@query("col_score")
def q_col_score(spark, sf_dir):
    s = reduce.column_scores(panel_customer(spark, sf_dir), ["before_cnt", "before_amt", "acctbal", "region"], "y")
    return s.select("feature", r("corr", 6).alias("corr"), r("std", 4).alias("std"), r("score", 4).alias("score"))


@query("pca_cap")
def q_pca_cap(spark, sf_dir):
    p = derive.numeric_derivatives(panel_customer(spark, sf_dir), NUM_COLS)
    nums = [c for c in p.columns if c not in ("id", "t", "seg", "y")]
    capped, _ = reduce.pca_cap(p.select("id", *nums), nums, cap=8, y=None)
    return capped


@query("leaf_embed")
def q_leaf(spark, sf_dir):
    p = panel_customer(spark, sf_dir)
    return reduce.leaf_embedding(p, ["before_cnt", "before_amt", "acctbal", "region"], "y",
                                 ).select("id", *[f"leaf_idx_{i}" for i in range(20)])


# ------------------------------------------------------------ P7 campaign
from causeway.plans import campaign as camp  # noqa: E402

CAMPAIGN_SPEC = camp.CampaignSpec(activity_id="cust-1998", created_at="2026-01-01T00:00:00Z")


def _customer_campaign(spark, sf_dir):
    return camp.campaign_analysis(panel_customer(spark, sf_dir), customer_cell(), CAMPAIGN_SPEC)


@query("campaign_result")
def q_campaign(spark, sf_dir):
    res, _ = _customer_campaign(spark, sf_dir)
    return camp.rounded_result(res, ["activity_id"])


@query("campaign_record")
def q_campaign_record(spark, sf_dir):
    res, _ = _customer_campaign(spark, sf_dir)
    return camp.result_record(res, CAMPAIGN_SPEC)


@query("user_uplift")
def q_user_uplift(spark, sf_dir):
    _, up = _customer_campaign(spark, sf_dir)
    return up.select("activity_uuid", "identity", "t_col", "y_col", "created_at",
                     r("tau_hat", 4).alias("tau_hat"), "psi")


@query("campaign_batch")
def q_campaign_batch(spark, sf_dir):
    """One campaign per market segment, all in one job (activity = segment)."""
    panel = panel_customer(spark, sf_dir).withColumn("activity_id", F.col("seg"))
    spec = camp.CampaignSpec(created_at="2026-01-01T00:00:00Z")
    res, _ = camp.campaign_analysis(panel, customer_cell(), spec, ["activity_id"])
    return camp.rounded_result(res, ["activity_id"])


# ------------------------------------------------------------ P8 documented extras
from causeway.operators import adjust  # noqa: E402


@query("cuped")
def q_cuped(spark, sf_dir):
    c = adjust.cuped(customer_folds(spark, sf_dir), "before_amt")
    s = adjust.cuped_summary(c)
    return s.select("n", r("diff", 4).alias("diff"), r("diff_cuped", 4).alias("diff_cuped"),
                    r("var_reduction", 6).alias("var_reduction"))


@query("ipcw")
def q_ipcw(spark, sf_dir):
    # outcomes were recorded for accounts in credit only; the flag is no function of y
    panel = customer_folds(spark, sf_dir).withColumn("seen", F.col("acctbal") > 0)
    nuis = strata_nuisance(panel.withColumn("y", F.when(F.col("seen"), F.col("y"))), customer_cell(), DEFAULT, y_scale=2)
    s = adjust.ipcw_ate(adjust.ipcw_weights(nuis, F.col("seen"), customer_cell()))
    return s.select("n", "n_observed", r("est_ipcw", 4).alias("est_ipcw"), r("se_ipcw", 4).alias("se_ipcw"))


@query("tmle")
def q_tmle(spark, sf_dir):
    s = adjust.tmle_step(customer_nuisance(spark, sf_dir))
    return s.select("n", r("epsilon", 4).alias("epsilon"), r("est", 4).alias("est"), r("se", 4).alias("se"),
                    r("ci_lo", 4).alias("ci_lo"), r("ci_hi", 4).alias("ci_hi"))


@query("uplift_curve")
def q_uplift_curve(spark, sf_dir):
    u = ranking.uplift_curve(customer_tau(spark, sf_dir), "tau")
    return u.select("q", "m", r("mean_uplift", 4).alias("mean_uplift"))


@query("qini_curve")
def q_qini(spark, sf_dir):
    u = ranking.qini_curve(customer_tau(spark, sf_dir), "tau")
    return u.select("q", "m", r("qini", 2).alias("qini"))


TRIM_BANDS = [(0.01, 0.99), (0.05, 0.95), (0.1, 0.9), (0.2, 0.8)]


@query("trim_sensitivity")
def q_trim(spark, sf_dir):
    t = adjust.trim_sensitivity(customer_nuisance(spark, sf_dir), TRIM_BANDS)
    return t.select("lo", "hi", "n_kept", r("est", 4).alias("est"), r("se", 4).alias("se"), "psi_abs_max",
                    r("psi_p95", 4).alias("psi_p95"), r("psi_p99", 4).alias("psi_p99"))


# ------------------------------------------------------------ P6 learners and HTE
from causeway.operators.nuisance import linear as lin  # noqa: E402
from causeway.operators.nuisance.forest import forest_nuisance  # noqa: E402

LEARN_X = ["before_cnt", "before_amt", "acctbal", "region"]
FOLDS = list(range(DEFAULT.n_splits))


@query("crossfit_linear1")
def q_linear1(spark, sf_dir):
    p = customer_folds(spark, sf_dir)
    coefs = lin.ols_oof(p, ["before_amt"], "y", FOLDS)
    out = p.withColumn("mu1", lin._predict(coefs, 1, ["before_amt"], FOLDS, "fold")) \
           .withColumn("mu0", lin._predict(coefs, 0, ["before_amt"], FOLDS, "fold"))
    return out.select("id", "fold", r("mu1", 4).alias("mu1"), r("mu0", 4).alias("mu0"))


@query("ate_linear")
def q_ate_linear(spark, sf_dir):
    nuis = lin.linear_nuisance(customer_folds(spark, sf_dir), LEARN_X, DEFAULT, FOLDS)
    return _effect_row(estimate.effect_table(nuis, "ATE", DEFAULT))


@query("ate_ml")
def q_ate_ml(spark, sf_dir):
    """Forests for the propensity and both arms of all five folds, grown together."""
    return _effect_row(estimate.effect_table(forest_nuisance(customer_folds(spark, sf_dir), LEARN_X, DEFAULT, FOLDS),
                                             "ATE", DEFAULT))


HTE_BAND = (0.2, 0.8)


@query("dr_forest")
def q_dr_forest(spark, sf_dir):
    t = hte.dr_forest(customer_nuisance(spark, sf_dir), LEARN_X, HTE_BAND)
    return t.select("id", "fold", r("tau", 4).alias("tau"))


@query("effect_interval")
def q_effect_interval(spark, sf_dir):
    t = hte.effect_intervals(customer_nuisance(spark, sf_dir), LEARN_X, HTE_BAND)
    return t.select("id", *[r(c, 4).alias(c) for c in ("tau", "tau_sd", "lb90", "ub90", "lb99", "ub99")])


@query("label_shares")
def q_label_shares(spark, sf_dir):
    nuis = customer_nuisance(spark, sf_dir)
    seg = hte.segment_effects(nuis, "cell").select(F.col("segment").alias("cell"), "lb99", "lb90")
    return hte.label_shares(join_small(nuis, seg, "cell", "left"))


# ------------------------------------------------------------ P7 distillation
from causeway.operators import distill  # noqa: E402


def segment_rules() -> list[dict]:
    """The strata cells written as rules (region × before-count bucket)."""
    rules = []
    buckets = [[("before_cnt", "<=", 1.0)], [("before_cnt", ">", 1.0), ("before_cnt", "<=", 3.0)],
               [("before_cnt", ">", 3.0)]]
    for region in range(5):
        for b, conds in enumerate(buckets):
            cs = [{"feature": "region", "op": "==", "threshold": float(region)}] + \
                 [{"feature": f, "op": op, "threshold": thr} for f, op, thr in conds]
            rules.append({"leaf": region * 3 + b, "value": None, "conditions": cs})
    return rules


def _tau_leaves(spark, sf_dir):
    return distill.apply_rules(customer_tau(spark, sf_dir), segment_rules())


@query("rule_apply")
def q_rule_apply(spark, sf_dir):
    return _tau_leaves(spark, sf_dir).select("id", "leaf")


@query("rule_value")
def q_rule_value(spark, sf_dir):
    v = distill.rule_values(_tau_leaves(spark, sf_dir))
    return v.select("leaf", "n", r("coverage", 6).alias("coverage"), r("uplift", 4).alias("uplift"),
                    r("value", 2).alias("value"))


@query("rule_bootstrap")
def q_rule_boot(spark, sf_dir):
    b = distill.rule_bootstrap(_tau_leaves(spark, sf_dir), reps=200)
    return b.select("leaf", r("lo90", 4).alias("lo90"), r("hi90", 4).alias("hi90"))




def _student(spark, sf_dir):
    tau = settle(customer_tau(spark, sf_dir))
    model, table = distill.student_tree(tau, LEARN_X)
    return tau, model, table


@query("student_tree")
def q_student(spark, sf_dir):
    tau, model, _ = _student(spark, sf_dir)
    rules = distill.extract_rules(model)
    leaves = distill.apply_rules(tau, rules)
    vals = distill.rule_values(leaves)
    return distill.rules_frame(spark, rules).select("leaf", "rule_text", "value").join(
        vals.select("leaf", "n", "coverage", "uplift", F.col("value").alias("psi_sum")), "leaf", "left")


@query("student_search")
def q_student_search(spark, sf_dir):
    """Depths 2 to 6 and three leaf sizes by the out-of-fold composite score."""
    return _student(spark, sf_dir)[2]


@query("distill_quality")
def q_distill_quality(spark, sf_dir):
    tau, model, _ = _student(spark, sf_dir)
    scored = trees.predict(tau, model).withColumnRenamed("_student", "student")
    return distill.distill_quality(scored, "tau", "student")


@query("distill_scores")
def q_distill_scores(spark, sf_dir):
    """The composite score and pass rule of given student scores, per region."""
    tau = customer_tau(spark, sf_dir).withColumn("student", F.round(F.col("before_amt") / 50_000) + F.col("before_cnt") % 3)
    d = distill.composite_table(tau, "tau", "student", group=["region"])
    values = [c for c in d.columns if c.startswith(("nauuc", "spearman", "policy_ratio", "score"))]
    return d.select("region", "n", *[r(c, 6).alias(c) for c in values], "passed",
                    *[r(c, 0).alias(c) for c in d.columns if c.startswith(("policy_teacher", "policy_student"))])


@query("teacher_band")
def q_teacher_band(spark, sf_dir):
    """Out-of-fold teacher effects inside the overlap band, with a calibrated propensity."""
    t = distill.teacher_scores(customer_folds(spark, sf_dir), LEARN_X, DEFAULT, FOLDS)
    return t.select("id", "fold", r("e", 6).alias("e"), r("psi", 4).alias("psi"), r("tau", 4).alias("tau"))


@query("oof_r2_linear")
def q_oof_r2(spark, sf_dir):
    nuis = customer_nuisance(spark, sf_dir)
    coefs = lin.ols_oof(nuis.withColumn("t", F.lit(1)), ["before_amt"], "psi", FOLDS)
    pred = nuis.withColumn("psi_hat", lin._predict(coefs, 1, ["before_amt"], FOLDS, "fold"))
    m = pred.agg(F.avg("psi").alias("_m")).first()["_m"]
    out = pred.agg(F.count(F.lit(1)).alias("n"),
                   (1 - F.try_divide(F.sum((F.col("psi") - F.col("psi_hat")) ** 2),
                                     F.sum((F.col("psi") - F.lit(m)) ** 2))).alias("r2_oof"))
    return out.select("n", r("r2_oof", 6).alias("r2_oof"))


# ------------------------------------------------------------ sources, recoding, tuning
from causeway.operators import tune as tuning  # noqa: E402
from causeway.sources import files  # noqa: E402


@query("scan_campaigns")
def q_scan(spark, sf_dir):
    df = files.scan_campaign_files(spark, sf_dir, token="orders")
    return df.select("o_orderkey", "o_totalprice", "activity_id")


@query("recode_onehot")
def q_recode(spark, sf_dir):
    p = panel_customer(spark, sf_dir)
    p = p.withColumn("before_amt_log1p", F.log1p("before_amt"))
    p = one_hot(p, "seg", drop_first=True, prefix="seg")
    p = one_hot(p.withColumn("region_s", F.col("region").cast("string")), "region_s", drop_first=True,
                prefix="region")
    keep = ["id", "t", "y", "before_amt_log1p"] + [c for c in p.columns if c.startswith(("seg_", "region_"))]
    return p.select(*[r(c, 6).alias(c) if c == "before_amt_log1p" else F.col(c) for c in keep if c != "region_s"])


@query("complete_cases")
def q_complete(spark, sf_dir):
    from causeway.sources.tables import read_table

    d = read_table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars")
    return files.complete_cases(d.join(read_table(spark, sf_dir, "labels", "doc_id", "quality"),
                                       "doc_id", "left")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality").cast("bigint").alias("n_quality"))


def _tune_query(objective):
    """The whole search: as many trials as it takes by itself, none left out after a good one."""
    def fn(spark, sf_dir):
        return tuning.tune(customer_folds(spark, sf_dir), LEARN_X, DEFAULT, FOLDS, objective, stop=None)
    return fn


for _objective in tuning.OBJECTIVES:
    QUERIES["tune_nauuc" if _objective == "nauuc_ci" else f"tune_{_objective}".replace("tune_nauuc", "tune_nauuc_plain")] = \
        _tune_query(_objective)


# ------------------------------------------------------------ cleaning, calibration, feature step
from causeway.operators import clean  # noqa: E402
from causeway.operators.features.factory import FeatureFactory  # noqa: E402
from causeway.operators.nuisance.calibrate import calibrate  # noqa: E402


@query("median_impute")
def q_median_impute(spark, sf_dir):
    p = panel_customer(spark, sf_dir).withColumn("y_obs", F.when(F.col("y") > 0, F.col("y")))
    out = clean.impute_median(p, "y_obs", out="y_imputed")
    return out.select("id", r("y_imputed", 4).alias("y_imputed"))


@query("band_choice")
def q_band_choice(spark, sf_dir):
    return clean.band_choice(customer_nuisance(spark, sf_dir), (0.3, 0.7), DEFAULT.n_splits)


@query("hte_verdict")
def q_hte_verdict(spark, sf_dir):
    a = ranking.nauuc(customer_tau(spark, sf_dir), "tau", centered=True, on_zero="null")
    return a.select("n", r("nauuc", 6).alias("nauuc"),
                    F.coalesce(F.col("nauuc") >= 0.35, F.lit(False)).alias("usable"))


@query("calibrated_propensity")
def q_calibrated(spark, sf_dir):
    nuis = lin.linear_nuisance(customer_folds(spark, sf_dir), LEARN_X, DEFAULT, FOLDS)
    cal = calibrate(nuis, DEFAULT, FOLDS, "isotonic")
    return _effect_row(estimate.effect_table(cal, "ATE", DEFAULT))


@query("feature_factory")
def q_factory(spark, sf_dir):
    ff = FeatureFactory(cat_cols=["seg"], num_cols=["before_cnt", "before_amt", "acctbal"],
                        group_keys=[["seg"]], max_total_cols=30)
    out = ff.fit_transform(customer_folds(spark, sf_dir))
    return out.select("id", *ff.feature_columns(out, customer_folds(spark, sf_dir)))


@query("feature_transform")
def q_feature_transform(spark, sf_dir):
    """Fitted on the labelled documents, applied to all documents."""
    from causeway.sources.tables import read_table

    ff = FeatureFactory(cat_cols=CAT_COLS, num_cols=["n_chars"], group_keys=[["lang"]], woe=True,
                        ratios=False, interactions=False, quantile_bins=0, poly2=False)
    ff.fit_transform(_docs_folded(spark, sf_dir), "quality")
    out = ff.transform(read_table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars"))
    fitted = [c for c in out.columns if c.endswith(("__te", "__woe", "__freq", "__mean", "__log1p"))]
    return out.select(F.col("doc_id").alias("id"), *[r(c, 6).alias(c) for c in fitted],
                      *[c for c in out.columns if c.endswith("__count")])


# ------------------------------------------------------------ cleaning steps and small scores
from causeway.functions import schema  # noqa: E402
from causeway.functions.scalar import fused_score, weight_cap  # noqa: E402
from causeway.operators.nuisance.ml import class_weights  # noqa: E402


@query("outcome_change")
def q_outcome_change(spark, sf_dir):
    out = schema.derived_outcome(panel_customer(spark, sf_dir), "y", "before_amt", "y_change")
    return out.select("id", r("y_change", 2).alias("y_change"))


@query("capped_weights")
def q_capped_weights(spark, sf_dir):
    t, e = F.col("t"), F.col("e")
    return customer_nuisance(spark, sf_dir).select(
        "id", r(weight_cap(t / e + (1 - t) / (1 - e), 1.5), 6).alias("weight"))


@query("finite_rows")
def q_finite_rows(spark, sf_dir):
    p = panel_customer(spark, sf_dir).withColumn("per_order", F.col("before_amt") / F.nullif(
        F.col("before_cnt").cast("double"), F.lit(0.0)))
    return clean.finite(p.withColumn("log_balance", F.when(F.col("acctbal") >= 0, F.log("acctbal"))),
                        "per_order", "log_balance").select("id", "per_order")


@query("repaired_predictions")
def q_repaired(spark, sf_dir):
    lost = F.col("acctbal") < 0
    nuis = customer_nuisance(spark, sf_dir)
    nuis = nuis.withColumn("mu1", F.when(~lost, F.col("mu1"))).withColumn(
        "mu0", F.when(lost, F.lit(float("nan"))).otherwise(F.col("mu0")))
    out = clean.repair_predictions(nuis)
    return out.where(lost).select("id", r("mu1", 4).alias("mu1"), r("mu0", 4).alias("mu0"))


@query("fused_scores")
def q_fused_scores(spark, sf_dir):
    return customer_tau(spark, sf_dir).select("id", r(fused_score("tau", "psi", 0.3), 4).alias("score"))


@query("validity_gate")
def q_validity_gate(spark, sf_dir):
    return clean.validity_gate(customer_tau(spark, sf_dir), DEFAULT.n_splits, group=["seg"])


@query("class_weights")
def q_class_weights(spark, sf_dir):
    panel = panel_customer(spark, sf_dir)
    rows = [(s, *class_weights(panel, s)) for s in ("balanced", "sqrt")]
    return spark.createDataFrame(rows, "scheme string, treated double, control double").select(
        "scheme", r("treated", 6).alias("treated"), r("control", 6).alias("control"))


# ------------------------------------------------------------ event-log panel (small-n case)
from causeway.sources.panels import event_cell, panel_events  # noqa: E402


@query("panel_events")
def q_panel_events(spark, sf_dir):
    return panel_events(spark, sf_dir)


@query("ate_events_strata")
def q_ate_events(spark, sf_dir):
    from causeway.operators.folds import assign_folds

    panel = assign_folds(panel_events(spark, sf_dir), DEFAULT.n_splits, DEFAULT.seed)
    nuis = strata_nuisance(panel, event_cell(), DEFAULT, y_scale=2)
    return _effect_row(estimate.effect_table(nuis, "ATE", DEFAULT))


# ------------------------------------------------------------ report rows (long form)
from causeway.sources.sinks import long_form  # noqa: E402


@query("campaign_report")
def q_campaign_report(spark, sf_dir):
    """The campaign result as (activity_id, section, key, value) report rows."""
    res, _ = _customer_campaign(spark, sf_dir)
    return long_form(camp.rounded_result(res, ["activity_id"]), ["activity_id"], "result")


@query("te_oof_stratified")
def q_te_strat(spark, sf_dir):
    """Target encoding with folds stratified on the (binary) target."""
    docs = encode.stratified_target_folds(labelled_documents(spark, sf_dir), "quality", DEFAULT.n_splits,
                                          DEFAULT.seed)
    out, _ = encode.target_encode_oof(docs, CAT_COLS, "quality", DEFAULT.n_splits)
    return out.select("id", "fold", *[r(f"{c}__te", 6).alias(f"{c}__te") for c in CAT_COLS])


@query("att_band")
def q_att_band(spark, sf_dir):
    """ATT re-estimated inside the overlap band 0.2 ≤ ê ≤ 0.8 (new cross-fit on the band rows)."""

    nuis = customer_nuisance(spark, sf_dir)
    band = nuis.where(F.col("e").between(0.2, 0.8)).select(*customer_folds(spark, sf_dir).columns)
    inner = strata_nuisance(band, customer_cell(), DEFAULT, y_scale=2)
    eff = _effect_row(estimate.effect_table(inner, "ATT", DEFAULT))
    kept = nuis.agg(F.count(F.when(F.col("e").between(0.2, 0.8) & (F.col("t") == 1), 1)).alias("treated_kept"),
                    F.count(F.when(F.col("t") == 1, 1)).alias("treated_total"))
    return attach(eff, kept, [])


@query("pca_add")
def q_pca_add(spark, sf_dir):
    p = panel_customer(spark, sf_dir)
    out = reduce.pca_features(p, ["before_cnt", "before_amt", "acctbal", "region"], 2)
    return out.select("id", "pca_1", "pca_2")


# ------------------------------------------------------------ missing outcomes, NULL groups, string ids
def customer_missing(spark, sf_dir):
    """Customer panel in which outcomes are missing by arm."""
    gone = ((F.col("t") == 1) & (F.col("id") % 10 == 0)) | ((F.col("t") == 0) & (F.col("id") % 10 < 7))
    return customer_folds(spark, sf_dir).withColumn("y", F.when(~gone, F.col("y")))


def _missing_effect(estimand):
    def fn(spark, sf_dir):
        nuis = strata_nuisance(customer_missing(spark, sf_dir), customer_cell(), DEFAULT, y_scale=2)
        return _effect_row(estimate.effect_table(nuis, estimand, DEFAULT))
    return fn


for _e in ("ATE", "ATT", "ATO"):
    QUERIES[f"{_e.lower()}_null_y"] = _missing_effect(_e)


@query("placebo_null_y")
def q_placebo_null_y(spark, sf_dir):
    runs = robust.placebo_runs(customer_missing(spark, sf_dir), customer_cell(), DEFAULT, 20, y_scale=2)
    return runs.select("run", r("ate", 4).alias("ate"), r("att", 4).alias("att"), r("ato", 4).alias("ato"))


def _ranked_panel(spark, sf_dir):
    """A NULL group, string ids, a score that a third of all rows share."""
    return panel_customer(spark, sf_dir).select(
        F.when(F.col("region") > 0, F.col("region").cast("string")).alias("grp"),
        F.concat(F.lit("cust-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("sid"),
        F.when(F.col("id") % 3 == 0, 0.0).when(F.col("id") % 50 == 1, None)
        .otherwise(F.floor(F.col("acctbal") / 500).cast("double")).alias("score"))


@query("rank_null_group")
def q_rank_null_group(spark, sf_dir):
    return ordered(_ranked_panel(spark, sf_dir), "score", False, "sid", ["grp"]).select("grp", "sid", "pos")


@query("quantiles_null_group")
def q_quantiles_null_group(spark, sf_dir):
    return exact_quantiles(_ranked_panel(spark, sf_dir), "score", [0.1, 0.25, 0.5, 0.75, 0.9], ["grp"])


@query("smd_offset")
def q_smd_offset(spark, sf_dir):
    """Balance of a time-stamp-sized feature equals that of the plain one."""
    nuis = customer_nuisance(spark, sf_dir).withColumn("at", F.col("before_cnt") + F.lit(1.7e9))
    s = diagnose.smd_table(nuis, ["at", "before_cnt"], "ATO", DEFAULT)
    return s.select("feature", r("smd", 6).alias("smd"))


@query("cuped_offset")
def q_cuped_offset(spark, sf_dir):
    panel = customer_folds(spark, sf_dir).withColumn("at", F.col("before_amt") / 1000 + F.lit(1.7e9))
    s = adjust.cuped_summary(adjust.cuped(panel, "at"))
    return s.select("n", r("diff_cuped", 2).alias("diff_cuped"), r("var_reduction", 5).alias("var_reduction"))


# ------------------------------------------------------------ NULL cells and NULL activities
@query("ate_null_cell")
def q_ate_null_cell(spark, sf_dir):
    """Rows whose stratum is NULL are a stratum."""
    nuis = strata_nuisance(customer_folds(spark, sf_dir), F.when(F.col("region") > 0, customer_cell()), DEFAULT,
                           y_scale=2)
    return _effect_row(estimate.effect_table(nuis, "ATE", DEFAULT))


@query("batch_null_activity")
def q_batch_null_activity(spark, sf_dir):
    """One campaign per segment; rows of one region have no activity and are one of their own."""
    panel = panel_customer(spark, sf_dir).withColumn("activity_id", F.when(F.col("region") > 0, F.col("seg")))
    spec = camp.CampaignSpec(created_at="2026-01-01T00:00:00Z")
    res, _ = camp.campaign_analysis(panel, customer_cell(), spec, ["activity_id"])
    return camp.rounded_result(res, ["activity_id"])


# ------------------------------------------------------------ placebo of linear learners
LINEAR_RUNS = 300


@query("placebo_linear")
def q_placebo_linear(spark, sf_dir):
    """300 exact permutations, every fold's linear propensity and outcome models refitted in each."""
    runs = robust.placebo_linear_runs(customer_folds(spark, sf_dir), ["before_amt"], DEFAULT, LINEAR_RUNS, ("y", "y_nc"))
    return runs.select("run", "outcome", "n", r("ate", 4).alias("ate"), r("att", 4).alias("att"), r("ato", 4).alias("ato"))


# ------------------------------------------------------------ trees grown together, degenerate arms
from causeway.operators import trees  # noqa: E402
from causeway.operators.nuisance.arms import arm_status, route_arms  # noqa: E402

TREE_CUTS = {"before_cnt": (0, 1, 2, 3, 4, 6, 8), "before_amt": tuple(range(0, 1_000_001, 100_000)),
             "acctbal": tuple(range(-500, 10_000, 500)), "region": (0, 1, 2, 3)}


@query("tree_depth2")
def q_tree_depth2(spark, sf_dir):
    """The nodes of a regression tree of depth 2 of the outcome (in cents), one per arm."""
    panel = panel_customer(spark, sf_dir)
    cents = F.round(F.col("y") * 100).cast("bigint")
    forest = trees.grow(panel, list(TREE_CUTS), [trees.Family(f"arm{a}", cents, F.col("t") == a) for a in (1, 0)], depth=2,
                        min_leaf=20, cuts=list(TREE_CUTS.values()))
    rows = [(name, node, int(f), int(forest.bin[m, 0, node]) if f >= 0 else -1, int(forest.weight[m, 0, node]),
             float(forest.value[m, 0, node]))
            for m, name in enumerate(forest.families) for node, f in enumerate(forest.feature[m, 0])
            if forest.weight[m, 0, node] > 0]   # at most 7 nodes a tree
    out = spark.createDataFrame(rows, "model string, node int, feature int, bin int, n int, mean double")
    return out.select("model", "node", "feature", "bin", "n", r("mean", 2).alias("mean"))


def _uneven_panel(spark, sf_dir):
    """A segment for each kind of arm: ordinary, constant, nearly all zero, very few and no treated rows."""
    seg, t, y = F.col("seg"), F.col("t"), F.col("y")
    keep_t = (F.when(seg == "HOUSEHOLD", F.col("id") % 40 == 0).when(seg == "MACHINERY", F.lit(False)).otherwise(F.lit(True)))
    return customer_folds(spark, sf_dir).withColumn("t", F.when(keep_t, t).otherwise(0)).withColumn(
        "y", F.when((seg == "BUILDING") & (F.col("t") == 1), 7.0)
        .when((seg == "FURNITURE") & (F.col("t") == 1) & (F.col("id") % 97 > 0), 0.0).otherwise(y))


@query("arm_fallbacks")
def q_arm_fallbacks(spark, sf_dir):
    s = arm_status(_uneven_panel(spark, sf_dir), group=["seg"], y_scale=2)
    return s.select("seg", "fold", "arm", "n", r("mean", 4).alias("mean"), r("spread", 4).alias("spread"),
                    r("zero_share", 6).alias("zero_share"), r("pooled_mean", 4).alias("pooled_mean"), "route")


@query("ate_arm_fallbacks")
def q_ate_arm_fallbacks(spark, sf_dir):
    """The effect per segment, every arm's outcome model by its route."""
    panel = _uneven_panel(spark, sf_dir)
    nuis = strata_nuisance(panel, customer_cell(), DEFAULT, ["seg"], y_scale=2)
    routed = route_arms(nuis, arm_status(panel, group=["seg"], y_scale=2), DEFAULT, group=["seg"])
    eff = estimate.effect_table(routed, "ATE", DEFAULT, ["seg"])
    return eff.select("seg", "n", r("est", 4).alias("est"), r("se", 4).alias("se"))


# ------------------------------------------------------------ mergeable statistics, file rejects, panel checks
from causeway.operators.mergeable import effect_stats, effects_from_stats, merge_stats  # noqa: E402


@query("late_arrivals")
def q_late_arrivals(spark, sf_dir):
    """Campaigns (segments) delivered in three parts: each part's statistics, merged."""
    panel = customer_folds(spark, sf_dir)
    parts = [effect_stats(panel.where(F.col("id") % 3 == i), customer_cell(), ["seg"], y_scale=2) for i in range(3)]
    merged = merge_stats(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["seg"])
    eff = effects_from_stats(keep(merged), DEFAULT, ["seg"], y_scale=2)
    return eff.select("seg", "estimand", "n", "n_treated", "n_control", r("est", 4).alias("est"), r("se", 4).alias("se"))


@query("csv_rejects")
def q_csv_rejects(spark, sf_dir):
    """Customers written as CSV lines, some of them broken, and read back."""
    from causeway.session import ensure_checkpoint_dir

    p = panel_customer(spark, sf_dir).select("id", "t", "y", "seg")
    amount = F.when(F.col("id") % 19 == 0, F.concat(F.lit("about "), F.col("y").cast("string"))).otherwise(F.col("y").cast("string"))
    line = F.concat_ws(",", F.col("id").cast("string"), F.when(F.col("id") % 23 == 0, "yes").otherwise(F.col("t").cast("string")),
                       amount, F.when(F.col("id") % 29 > 0, F.col("seg")))   # a NULL leaves its field out
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    p.select(line.alias("value")).write.text(path)
    schema = p.select("id", F.col("t").cast("int").alias("t"), "y", "seg").schema
    good, rejects = files.read_csv_split(spark, path, schema, header=False)
    whole = files.validate_panel(good).agg(F.lit("rows").alias("kind"), F.count(F.lit(1)).alias("n"),
                                           F.sum("id").alias("id_sum"), r(F.sum("y"), 2).alias("y_sum"))
    lost = rejects.agg(F.lit("rejects").alias("kind"), F.count(F.lit(1)).alias("n"),
                       F.sum(F.split("line", ",")[0].cast("long")).alias("id_sum"), F.lit(None).cast("double").alias("y_sum"))
    return whole.unionByName(lost)


@query("panel_faults")
def q_panel_faults(spark, sf_dir):
    p = panel_customer(spark, sf_dir).select(
        F.when(F.col("id") % 50 > 0, F.col("id") - F.col("id") % 7 % 2).alias("id"),
        F.when(F.col("id") % 31 == 0, 2).when(F.col("id") % 37 > 0, F.col("t")).alias("t"),
        F.when(F.col("id") % 41 == 0, float("nan")).when(F.col("id") % 43 > 0, F.col("y")).alias("y"))
    return files.panel_faults(p)


# ------------------------------------------------------------ saved features, symbolic search
from causeway.operators.features import saved, symbolic  # noqa: E402


@query("feature_saved")
def q_feature_saved(spark, sf_dir):
    """``feature_transform`` by a model that was saved and read back."""
    from causeway.session import ensure_checkpoint_dir
    from causeway.sources.tables import read_table

    ff = FeatureFactory(cat_cols=CAT_COLS, num_cols=["n_chars"], group_keys=[["lang"]], woe=True,
                        ratios=False, interactions=False, quantile_bins=0, poly2=False)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    saved.fit_and_save(ff, _docs_folded(spark, sf_dir), path, "quality")
    out = saved.FeatureModel.load(path).transform(read_table(spark, sf_dir, "documents", "doc_id", "lang", "source", "n_chars"))
    fitted = [c for c in out.columns if c.endswith(("__te", "__woe", "__freq", "__mean", "__log1p"))]
    return out.select(F.col("doc_id").alias("id"), *[r(c, 6).alias(c) for c in fitted],
                      *[c for c in out.columns if c.endswith("__count")])


SYMBOLIC_X = ("before_cnt", "before_amt", "acctbal")


@query("symbolic_scores")
def q_symbolic_scores(spark, sf_dir):
    """Every expression one step from the columns, scored against the outcome."""
    cols = [("col", c) for c in SYMBOLIC_X]
    s = symbolic.scored(panel_customer(spark, sf_dir), cols + symbolic.grown(cols, cols), "y")
    return s.select("expression", "size", "n", r("corr", 6).alias("corr"), r("score", 6).alias("score"))


@query("symbolic_search")
def q_symbolic_search(spark, sf_dir):
    _, table = symbolic.symbolic_search(panel_customer(spark, sf_dir), SYMBOLIC_X, "y")
    return table


# ------------------------------------------------------------ campaign diagnosis, the learned campaign
@query("campaign_diagnosis")
def q_campaign_diagnosis(spark, sf_dir):
    parts = camp.campaign_parts(panel_customer(spark, sf_dir), customer_cell(), CAMPAIGN_SPEC)
    d = camp.campaign_diagnosis(parts, BALANCE_FEATURES, CAMPAIGN_SPEC)
    six = ("ovl", "ks", "smd_max", "placebo_p", "band_coverage", "nauuc")
    return d.select("activity_id", "n", *[r(c, 6).alias(c) for c in six], *[r(f"policy_{k}", 2).alias(f"policy_{k}") for k in (10, 20, 30)],
                    "overlap_pass", "balance_pass", "placebo_pass", "negctrl_pass", "n_pass", "verdict", "n_band", "note")


@query("campaign_full")
def q_campaign_full(spark, sf_dir):
    """Features, tuner, forest nuisances, effects, diagnosis and a forest τ̂ of one campaign."""
    res, _ = camp.full_campaign(panel_customer(spark, sf_dir), ["seg"], ["before_cnt", "before_amt", "acctbal"], [["seg"]],
                                CAMPAIGN_SPEC, trials=2, trees=40)
    return res


@query("campaign_record_flat")
def q_campaign_record_flat(spark, sf_dir):
    """The nested result record read back column by column."""
    return camp.flat_record(q_campaign_record(spark, sf_dir))


@query("campaign_text")
def q_campaign_text(spark, sf_dir):
    """The text report of every segment's campaign."""
    from causeway.plans.report import report_table

    panel = panel_customer(spark, sf_dir).withColumn("activity_id", F.col("seg"))
    parts = camp.campaign_parts(panel, customer_cell(), camp.CampaignSpec())
    return report_table(parts.ate, camp.campaign_diagnosis(parts, BALANCE_FEATURES), camp.CAMPAIGN_CFG.rules)


@query("calibrated_sigmoid")
def q_calibrated_sigmoid(spark, sf_dir):
    nuis = lin.linear_nuisance(customer_folds(spark, sf_dir), LEARN_X, DEFAULT, FOLDS)
    return _effect_row(estimate.effect_table(calibrate(nuis, DEFAULT, FOLDS, "sigmoid"), "ATE", DEFAULT))
