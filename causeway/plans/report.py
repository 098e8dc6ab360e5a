"""Text rendering of one-row summaries on the driver (the reports of the
estimator, the HTE tester and the campaign).  Only already aggregated rows
are rendered; the metrics themselves stay DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from causeway.config import Rules


def _f(v, spec: str = ".6f") -> str:
    return "n/a" if v is None else format(v, spec)


def effect_report(estimand: str, eff: Row, ovl: float | None, ks: float | None, smd_max: float | None,
                  placebo_p: float | None, negctrl_p: float | None, verdict: str,
                  rules: Rules = Rules()) -> str:
    lines = [f"[{estimand}] estimate = {_f(eff['est'])}, 95% CI = [{_f(eff['ci_lo'])}, {_f(eff['ci_hi'])}]",
             f"- overlap: OVL = {_f(ovl, '.3f')} (>= {rules.ovl_min}), KS = {_f(ks, '.3f')} (<= {rules.ks_max})",
             f"- balance: max |SMD| = {_f(smd_max, '.3f')} (<= {rules.smd_max})",
             f"- placebo permutation: p = {_f(placebo_p, '.3f')} (>= {rules.placebo_alpha})"]
    if negctrl_p is not None:
        lines.append(f"- negative control: p = {_f(negctrl_p, '.3f')} (>= {rules.nc_alpha})")
    lines.append(f"- verdict: {verdict}")
    return "\n".join(lines)


def hte_report(nauuc: float | None, policy: dict[int, float], coverage: float | None, n: int,
               band: tuple[float, float], min_nauuc: float = 0.35) -> str:
    usable = nauuc is not None and nauuc >= min_nauuc
    pol = " / ".join(f"@{k}: {_f(v, '.2f')}" for k, v in sorted(policy.items()))
    return "\n".join([f"[HTE] band e in [{band[0]:.2f}, {band[1]:.2f}], coverage {_f(coverage, '.2%')}, n = {n}",
                      f"- nAUUC = {_f(nauuc, '.3f')} (usable if >= {min_nauuc}): {'yes' if usable else 'no'}",
                      f"- policy value {pol}"])


def campaign_report_text(rec: Row) -> str:
    """One campaign result row (flat form) as text."""
    return "\n".join([
        f"[campaign {rec['activity_id']}] n = {rec['n_samples']} (treated {rec['n_treated']}, "
        f"control {rec['n_control']})",
        f"- ATE = {_f(rec['ate_point'], '.4f')} [{_f(rec['ate_ci_lo'], '.4f')}, {_f(rec['ate_ci_hi'], '.4f')}],"
        f" placebo p = {_f(rec['ate_placebo_p'], '.3f')}",
        f"- ATT (band) = {_f(rec['att_point'], '.4f')} [{_f(rec['att_ci_lo'], '.4f')}, "
        f"{_f(rec['att_ci_hi'], '.4f')}], treated kept {rec['treated_kept']}/{rec['treated_total']}",
        f"- tau quantiles p10..p90 = " + ", ".join(_f(rec[f"tau_p{p}"], '.2f') for p in (10, 25, 50, 75, 90)),
    ])


def _shown(name: str, digits: int) -> Column:
    return F.coalesce(F.format_number(name, digits), F.lit("n/a"))


def report_table(effect: DataFrame, diagnosis: DataFrame, rules: Rules = Rules(), estimand: str = "ATE") -> DataFrame:
    """(activity_id, report): the text report of every activity as a column, built
    by the engine.  ``effect`` has activity_id, est, ci_lo, ci_hi; ``diagnosis`` is
    that of the campaign plan."""
    d = diagnosis.withColumnRenamed("activity_id", "_activity")
    j = effect.select("activity_id", "est", "ci_lo", "ci_hi").join(d, F.col("activity_id").eqNullSafe(F.col("_activity")))
    lines = [
        F.concat(F.lit(f"[{estimand}] estimate = "), _shown("est", 4), F.lit(", 95% CI = ["), _shown("ci_lo", 4), F.lit(", "),
                 _shown("ci_hi", 4), F.lit("]")),
        F.concat(F.lit("- overlap: OVL = "), _shown("ovl", 3), F.lit(f" (>= {rules.ovl_min}), KS = "), _shown("ks", 3),
                 F.lit(f" (<= {rules.ks_max})")),
        F.concat(F.lit("- balance: max |SMD| = "), _shown("smd_max", 3), F.lit(f" (<= {rules.smd_max})")),
        F.concat(F.lit("- placebo permutation: p = "), _shown("placebo_p", 3), F.lit(f" (>= {rules.placebo_alpha})")),
        F.concat(F.lit("- ranking in the band: nAUUC = "), _shown("nauuc", 3), F.lit(", policy@10/20/30 = "),
                 F.concat_ws(" / ", *[_shown(f"policy_{k}", 2) for k in (10, 20, 30)]),
                 F.coalesce(F.concat(F.lit(" ("), "note", F.lit(")")), F.lit(""))),
        F.concat(F.lit("- verdict: "), F.coalesce("verdict", F.lit("n/a")))]
    return j.select("activity_id", F.concat_ws("\n", *lines).alias("report"))
