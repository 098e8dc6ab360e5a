"""SQL twins of the named queries, written for DuckDB over the same tables.

They are independent restatements: out-of-fold statistics are computed by a
join on "same cell, other fold" instead of total-minus-own, ranks by a
global ``row_number``, permutations by a per-run ``row_number`` — the plain
textbook forms that are fine at test scale.
"""

from __future__ import annotations

SEED = 42
K = 5
TRIM = 0.01
PS_LO, PS_HI = 0.01, 0.99
Z975 = 1.959963984540054


def md5_int(id_expr: str, salt: str) -> str:
    return (f"CAST(('0x' || substr(md5(concat(CAST({id_expr} AS VARCHAR), ':', {salt})), 1, 15))"
            f" AS BIGINT)")


def cents(x: str) -> str:
    return f"CAST(round({x} * 100) AS BIGINT)"


PANEL_CUSTOMER = f"""
SELECT c.c_custkey AS id,
       CAST(coalesce(o.t_any, 0) AS INTEGER) AS t,
       coalesce(CAST(o.y_sum AS DOUBLE) / CAST(100 AS DOUBLE), CAST(0 AS DOUBLE)) AS y,
       coalesce(CAST(o.nc_sum AS DOUBLE) / CAST(100 AS DOUBLE), CAST(0 AS DOUBLE)) AS y_nc,
       CAST(coalesce(o.before_n, 0) AS BIGINT) AS before_cnt,
       coalesce(CAST(o.before_sum AS DOUBLE) / CAST(100 AS DOUBLE), CAST(0 AS DOUBLE)) AS before_amt,
       c.c_mktsegment AS seg,
       CAST(n.n_regionkey AS INTEGER) AS region,
       c.c_acctbal AS acctbal
FROM customer c
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (
  SELECT o_custkey,
    max(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
              AND o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
             THEN 1 ELSE 0 END) AS t_any,
    sum(CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-01-01'
             THEN {cents('o_totalprice')} END) AS y_sum,
    sum(CASE WHEN o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
             THEN {cents('o_totalprice')} END) AS nc_sum,
    count(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 1 END) AS before_n,
    sum(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN {cents('o_totalprice')} END) AS before_sum
  FROM orders
  WHERE o_orderdate < TIMESTAMP '2000-01-01'
  GROUP BY o_custkey
) o ON o.o_custkey = c.c_custkey
"""

PANEL_ORDERS = """
SELECT o.o_orderkey AS id,
       CAST(o.o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS t,
       o.o_totalprice AS y,
       o.o_orderstatus AS status,
       CAST(n.n_regionkey AS INTEGER) AS region
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

CUSTOMER_CELL = "(region * 3 + least(before_cnt, 4) // 2)"
ORDER_CELL = ("((CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END) * 5"
              " + region)")


def folded(panel_sql: str, cell_sql: str, seed: int = SEED, k: int = K) -> str:
    return (f"SELECT *, CAST({md5_int('id', repr(str(seed)))} % {k} AS INTEGER) AS fold, "
            f"CAST({cell_sql} AS INTEGER) AS cell FROM ({panel_sql})")


def strata_ctes(panel_sql: str, cell_sql: str, y: str = "y", prefix: str = "", seed: int = SEED,
                k: int = K, ps: tuple[float, float] = (PS_LO, PS_HI)) -> str:
    """CTEs p (panel+fold+cell) … nu (row-level e, mu1, mu0, psi)."""
    return f"""
{prefix}p AS ({folded(panel_sql, cell_sql, seed, k)}),
{prefix}pk AS (SELECT DISTINCT fold, cell FROM {prefix}p),
{prefix}trc AS (
  SELECT k.fold, k.cell,
         count(CASE WHEN q.t = 1 THEN 1 END) AS n1, count(CASE WHEN q.t = 1 THEN q.{y} END) AS m1,
         count(CASE WHEN q.t = 0 THEN 1 END) AS n0, count(CASE WHEN q.t = 0 THEN q.{y} END) AS m0,
         sum(CASE WHEN q.t = 1 THEN {cents('q.' + y)} END) AS s1,
         sum(CASE WHEN q.t = 0 THEN {cents('q.' + y)} END) AS s0
  FROM {prefix}pk k LEFT JOIN {prefix}p q ON q.cell IS NOT DISTINCT FROM k.cell AND q.fold <> k.fold
  GROUP BY k.fold, k.cell),
{prefix}tra AS (
  SELECT f.fold,
         count(CASE WHEN q.t = 1 THEN 1 END) AS n1, count(CASE WHEN q.t = 1 THEN q.{y} END) AS m1,
         count(CASE WHEN q.t = 0 THEN 1 END) AS n0, count(CASE WHEN q.t = 0 THEN q.{y} END) AS m0,
         sum(CASE WHEN q.t = 1 THEN {cents('q.' + y)} END) AS s1,
         sum(CASE WHEN q.t = 0 THEN {cents('q.' + y)} END) AS s0
  FROM (SELECT DISTINCT fold FROM {prefix}p) f LEFT JOIN {prefix}p q ON q.fold <> f.fold
  GROUP BY f.fold),
{prefix}oof AS (
  SELECT c.fold, c.cell,
    CASE WHEN c.n1 + c.n0 > 0 THEN CAST(c.n1 AS DOUBLE) / (c.n1 + c.n0)
         WHEN a.n1 + a.n0 > 0 THEN CAST(a.n1 AS DOUBLE) / (a.n1 + a.n0)
         ELSE 0.5 END AS e_raw,
    CASE WHEN c.m1 > 0 THEN CAST(c.s1 AS DOUBLE) / CAST(100 AS DOUBLE) / c.m1
         WHEN a.m1 > 0 THEN CAST(a.s1 AS DOUBLE) / CAST(100 AS DOUBLE) / a.m1
         ELSE CAST(0 AS DOUBLE) END AS mu1,
    CASE WHEN c.m0 > 0 THEN CAST(c.s0 AS DOUBLE) / CAST(100 AS DOUBLE) / c.m0
         WHEN a.m0 > 0 THEN CAST(a.s0 AS DOUBLE) / CAST(100 AS DOUBLE) / a.m0
         ELSE CAST(0 AS DOUBLE) END AS mu0
  FROM {prefix}trc c JOIN {prefix}tra a USING (fold)),
{prefix}nu0 AS (
  SELECT p.*, o.e_raw,
         greatest(least(greatest(least(o.e_raw, {1 - TRIM}), {TRIM}), {ps[1]}), {ps[0]}) AS e,
         o.mu1, o.mu0
  FROM {prefix}p p JOIN {prefix}oof o ON o.fold = p.fold AND o.cell IS NOT DISTINCT FROM p.cell),
{prefix}nu AS (
  SELECT *, t * ({y} - mu1) / e - (1 - t) * ({y} - mu0) / (1 - e) + (mu1 - mu0) AS psi
  FROM {prefix}nu0)"""


def effect_select(src: str, estimand: str) -> str:
    """n, n_treated, n_control, est, se, ci_lo, ci_hi — two-pass textbook form."""
    counts = ("count(*) AS n, count(CASE WHEN t = 1 THEN 1 END) AS n_treated, "
              "count(CASE WHEN t = 0 THEN 1 END) AS n_control")
    src = f"(SELECT * FROM {src} WHERE psi IS NOT NULL)"
    if estimand == "ATE":
        inner = f"SELECT {counts}, avg(psi) AS est, stddev_samp(psi) / sqrt(count(*)) AS se FROM {src}"
    elif estimand == "ATT":
        inner = f"""
WITH a AS (SELECT *, t * (y - mu0) - (1 - t) * (e / (1 - e)) * (y - mu0) AS term FROM {src}),
     s AS (SELECT avg(t) AS p1, avg(term) / (avg(t) + 1e-12) AS est FROM a)
SELECT {counts}, max(s.est) AS est,
       stddev_samp(a.term / (s.p1 + 1e-12) - s.est * ((a.t - s.p1) / (s.p1 + 1e-12))) / sqrt(count(*)) AS se
FROM a, s"""
    else:
        inner = f"""
WITH a AS (SELECT *, 4.0 * e * (1 - e) AS w FROM {src}),
     s AS (SELECT sum(w * psi) / (sum(w) + 1e-12) AS est, avg(w) AS mw FROM a)
SELECT {counts}, max(s.est) AS est,
       stddev_samp((a.w / (s.mw + 1e-12)) * (a.psi - s.est)) / sqrt(count(*)) AS se
FROM a, s"""
    return f"""
SELECT n, n_treated, n_control, round(est, 4) + 0.0 AS est, round(se, 4) + 0.0 AS se,
       round(est - {Z975} * se, 4) + 0.0 AS ci_lo, round(est + {Z975} * se, 4) + 0.0 AS ci_hi
FROM ({inner})"""


def with_customer(body: str, y: str = "y") -> str:
    return f"WITH {strata_ctes(PANEL_CUSTOMER, CUSTOMER_CELL, y)}\n{body}"


ORACLE: dict[str, str] = {}

ORACLE["panel_customer"] = PANEL_CUSTOMER
ORACLE["panel_orders"] = PANEL_ORDERS
ORACLE["fold_assign"] = f"""
SELECT fold, t, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum
FROM ({folded(PANEL_CUSTOMER, CUSTOMER_CELL)}) GROUP BY fold, t"""
ORACLE["nuisance_strata"] = with_customer("SELECT id, fold, cell, e_raw, e, mu1, mu0, psi FROM nu")
ORACLE["ate_aipw_strata"] = with_customer(effect_select("nu", "ATE"))
ORACLE["att_strata"] = with_customer(effect_select("nu", "ATT"))
ORACLE["ato_strata"] = with_customer(effect_select("nu", "ATO"))
ORACLE["ate_orders_strata"] = f"WITH {strata_ctes(PANEL_ORDERS, ORDER_CELL)}\n{effect_select('nu', 'ATE')}"
ORACLE["naive_diff"] = f"""
SELECT round(mt, 4) + 0.0 AS mean_treated, round(mc, 4) + 0.0 AS mean_control,
       round(mt - mc, 4) + 0.0 AS naive_diff
FROM (SELECT avg(CASE WHEN t = 1 THEN y END) AS mt, avg(CASE WHEN t = 0 THEN y END) AS mc
      FROM ({PANEL_CUSTOMER}))"""
ORACLE["ci_width_norm"] = with_customer("""
SELECT n, round(w, 4) + 0.0 AS ci_width, round(w / greatest(sdy, 1e-8), 6) + 0.0 AS ci_width_norm
FROM (SELECT count(*) AS n, 2 * 1.96 * stddev_samp(psi) / sqrt(count(*)) AS w,
             stddev_samp(y) AS sdy FROM nu)""")
ORACLE["fold_variance"] = with_customer("""
SELECT count(*) AS n_folds, round(avg(v), 2) + 0.0 AS fold_variance
FROM (SELECT fold, var_samp(psi) / count(*) AS v FROM nu GROUP BY fold)""")

# ------------------------------------------------------------ P2 diagnostics
ORACLE["ks_overlap"] = with_customer("""
, v AS (SELECT e, count(CASE WHEN t = 1 THEN 1 END) AS c1, count(CASE WHEN t = 0 THEN 1 END) AS c0
        FROM nu GROUP BY e),
w AS (SELECT c1, c0,
             sum(c1) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) AS cum1,
             sum(c0) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) AS cum0,
             sum(c1) OVER () AS n1, sum(c0) OVER () AS n0 FROM v)
SELECT max(abs(cum1 / n1 - cum0 / n0)) AS ks,
       max(greatest(abs(cum1 / n1 - cum0 / n0), abs(cum1 / n1 - (cum0 - c0) / n0))) AS ks_reference
FROM w""")

ORACLE["ovl_overlap"] = with_customer("""
SELECT round(sum(least(c1 / n1, c0 / n0)), 6) + 0.0 AS ovl
FROM (SELECT least(floor(e * 50), 49) AS bin, count(CASE WHEN t = 1 THEN 1 END) AS c1,
             count(CASE WHEN t = 0 THEN 1 END) AS c0 FROM nu GROUP BY 1) b,
     (SELECT count(CASE WHEN t = 1 THEN 1 END) AS n1, count(CASE WHEN t = 0 THEN 1 END) AS n0 FROM nu) s""")

_W = {"ATE": ("t / e", "(1 - t) / (1 - e)"),
      "ATT": ("1.0", "(1 - t) * (e / (1 - e))"),
      "ATO": ("t * (1 - e)", "(1 - t) * e")}


def _ess(est: str) -> str:
    wt, wc = _W[est]
    ess_t = ("CAST(NULL AS DOUBLE)" if est == "ATT" else
             f"round(sum(CASE WHEN t = 1 THEN {wt} END) ^ 2 / (sum(CASE WHEN t = 1 THEN ({wt}) * ({wt}) END) + 1e-12)"
             f" / (count(CASE WHEN t = 1 THEN 1 END) + 1e-12), 6) + 0.0")
    ess_c = (f"round(sum(CASE WHEN t = 0 THEN {wc} END) ^ 2 / (sum(CASE WHEN t = 0 THEN ({wc}) * ({wc}) END) + 1e-12)"
             f" / (count(CASE WHEN t = 0 THEN 1 END) + 1e-12), 6) + 0.0")
    return f"SELECT '{est}' AS estimand, {ess_t} AS ess_t, {ess_c} AS ess_c FROM nu"


ORACLE["ess_ratio"] = with_customer("\nUNION ALL\n".join(_ess(e) for e in ("ATE", "ATT", "ATO")))


def _tails(est: str) -> str:
    wt, wc = _W[est]
    where = "WHERE t = 0" if est == "ATT" else ""
    w = f"CASE WHEN t = 1 THEN {wt} ELSE {wc} END"
    return (f"SELECT '{est}' AS estimand, t AS arm, round(quantile_cont({w}, 0.99), 6) + 0.0 AS w_p99, "
            f"round(max({w}), 6) + 0.0 AS w_max FROM nu {where} GROUP BY t")


ORACLE["weight_tails"] = with_customer("\nUNION ALL\n".join(_tails(e) for e in ("ATE", "ATT", "ATO")))

SEG_LEVELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
BAL = ["before_cnt", "before_amt", "acctbal", "region"] + [f"seg_{v}" for v in SEG_LEVELS[1:]]


def _smd(est: str) -> str:
    wt, wc = _W[est]
    dummies = ", ".join(f"CAST(CASE WHEN seg = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS seg_{v}"
                        for v in SEG_LEVELS[1:])
    base = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in BAL[:4])
    treated = ("avg(x)", "var_pop(x)") if est == "ATT" else None
    return f"""
, sm AS (SELECT t, e, {base}, {dummies} FROM nu),
lg AS (UNPIVOT sm ON {', '.join(BAL)} INTO NAME feature VALUE x),
wx AS (SELECT feature, t, x, CASE WHEN t = 1 THEN {wt} ELSE {wc} END AS w FROM lg WHERE x IS NOT NULL),
mm AS (SELECT feature, t, sum(w * x) / (sum(w) + 1e-12) AS wm, sum(w) AS sw,
              avg(x) AS um, var_pop(x) AS uv FROM wx GROUP BY feature, t),
vv AS (SELECT wx.feature, wx.t, max(mm.wm) AS wm, sum(wx.w * (wx.x - mm.wm) * (wx.x - mm.wm)) / (max(mm.sw) + 1e-12) AS wv,
              max(mm.um) AS um, max(mm.uv) AS uv
       FROM wx JOIN mm ON wx.feature = mm.feature AND wx.t = mm.t GROUP BY wx.feature, wx.t),
ar AS (SELECT feature,
         max(CASE WHEN t = 1 THEN {'um' if treated else 'wm'} END) AS m1, max(CASE WHEN t = 1 THEN {'uv' if treated else 'wv'} END) AS v1,
         max(CASE WHEN t = 0 THEN wm END) AS m0, max(CASE WHEN t = 0 THEN wv END) AS v0,
         count(CASE WHEN t = 1 THEN 1 END) AS k1, count(CASE WHEN t = 0 THEN 1 END) AS k0
       FROM vv GROUP BY feature),
sd AS (SELECT feature, CASE WHEN k1 > 0 AND k0 > 0 THEN (m1 - m0) / (sqrt((v1 + v0) / 2.0 + 1e-12) + 1e-12) END AS smd FROM ar)"""


for _e in ("ATE", "ATT", "ATO"):
    ORACLE[f"smd_{_e.lower()}"] = with_customer(_smd(_e) + "\nSELECT feature, round(smd, 6) + 0.0 AS smd FROM sd")
ORACLE["smd_topk"] = with_customer(_smd("ATE") + """
SELECT rank, feature, round(smd, 6) + 0.0 AS smd FROM (
  SELECT feature, smd, row_number() OVER (ORDER BY abs(smd) DESC, feature) AS rank FROM sd WHERE smd IS NOT NULL)
WHERE rank <= 5""")
ORACLE["band_coverage"] = with_customer("""
SELECT count(*) AS n, count(CASE WHEN e BETWEEN 0.3 AND 0.7 THEN 1 END) AS n_band,
       count(CASE WHEN e BETWEEN 0.3 AND 0.7 AND t = 1 THEN 1 END) AS n_band_treated,
       count(CASE WHEN e BETWEEN 0.3 AND 0.7 AND t = 0 THEN 1 END) AS n_band_control,
       round(count(CASE WHEN e BETWEEN 0.3 AND 0.7 THEN 1 END) / count(*), 6) + 0.0 AS coverage
FROM nu""")
ORACLE["propensity_summary"] = with_customer(
    "SELECT round(avg(e), 6) + 0.0 AS e_mean, min(e) AS e_min, max(e) AS e_max FROM nu")

# ------------------------------------------------------------ P3 ranking
def tau_ctes(prefix: str = "", band: tuple[float, float] | None = None, k: int = K) -> str:
    """Segment effects of the other folds; with ``band`` learned from its rows (or, where
    they are too few or of one arm, those of the base band or all)."""
    nu, src = f"{prefix}nu", f"{prefix}nu"
    first = ""
    if band:
        src = f"(SELECT * FROM {nu}, {prefix}bc WHERE e BETWEEN blo AND bhi)"
        first = f"""
, {prefix}bc AS (SELECT CASE WHEN nb < {max(50, 3 * k)} OR n1 = 0 OR n0 = 0 THEN 0.0 WHEN nb < {max(100, 3 * k)} THEN 0.1 ELSE {band[0]} END AS blo,
                 CASE WHEN nb < {max(50, 3 * k)} OR n1 = 0 OR n0 = 0 THEN 1.0 WHEN nb < {max(100, 3 * k)} THEN 0.9 ELSE {band[1]} END AS bhi
          FROM (SELECT count(*) AS nb, count(CASE WHEN t = 1 THEN 1 END) AS n1, count(CASE WHEN t = 0 THEN 1 END) AS n0
                FROM {nu} WHERE e BETWEEN {band[0]} AND {band[1]}))"""
    return first + f"""
, {prefix}tk AS (SELECT DISTINCT fold, cell FROM {nu}),
{prefix}tt AS (SELECT k.fold, k.cell, avg(q.psi) AS tau_c, count(q.psi) AS cnt
       FROM {prefix}tk k LEFT JOIN {src} q ON q.cell = k.cell AND q.fold <> k.fold GROUP BY k.fold, k.cell),
{prefix}tf AS (SELECT f.fold, avg(q.psi) AS tau_f
       FROM (SELECT DISTINCT fold FROM {nu}) f LEFT JOIN {src} q ON q.fold <> f.fold GROUP BY f.fold),
{prefix}ht AS (SELECT {nu}.*, CASE WHEN tt.cnt > 0 THEN tt.tau_c WHEN tf.tau_f IS NOT NULL THEN tf.tau_f
                         ELSE 0.0 END AS tau
       FROM {nu} JOIN {prefix}tt tt USING (fold, cell) JOIN {prefix}tf tf USING (fold))"""


TAU_CTES = tau_ctes()


def with_tau(body: str) -> str:
    return with_customer(TAU_CTES + "\n" + body)


def _area(score: str, centered: bool, src: str = "ht", part: str = "") -> str:
    """Trapezoid area of cumulative ψ (centered or not) by explicit running sums."""
    pby = f"PARTITION BY {part}" if part else ""
    keys = f"{part}, " if part else ""
    v = f"psi - avg(psi) OVER ({pby})" if centered else "psi"
    return f"""
SELECT {keys}max(n) AS n, (sum(cs) - (max(CASE WHEN rk = 1 THEN cs END) + max(CASE WHEN rk = n THEN cs END)) / 2.0) / max(n) AS area
FROM (SELECT {keys}rk, n, sum(v) OVER ({pby} ORDER BY rk ROWS UNBOUNDED PRECEDING) AS cs
      FROM (SELECT {keys}{v} AS v, count(*) OVER ({pby}) AS n,
                   row_number() OVER ({pby} ORDER BY {score} DESC NULLS LAST, id) AS rk
            FROM {src} WHERE psi IS NOT NULL))
{'GROUP BY ' + part if part else ''}"""


ORACLE["dr_segment"] = with_tau("SELECT id, fold, round(tau, 4) + 0.0 AS tau FROM ht")
ORACLE["dr_segment_effects"] = with_customer("""
SELECT segment, n, round(tau, 4) + 0.0 AS tau, round(se, 4) + 0.0 AS se,
       round(tau - 1.6448536269514722 * se, 4) + 0.0 AS lb90, round(tau + 1.6448536269514722 * se, 4) + 0.0 AS ub90,
       round(tau - 1.959963984540054 * se, 4) + 0.0 AS lb95, round(tau + 1.959963984540054 * se, 4) + 0.0 AS ub95,
       round(tau - 2.5758293035489004 * se, 4) + 0.0 AS lb99, round(tau + 2.5758293035489004 * se, 4) + 0.0 AS ub99
FROM (SELECT cell AS segment, count(*) AS n, avg(psi) AS tau, stddev_samp(psi) / sqrt(count(*)) AS se
      FROM nu WHERE psi IS NOT NULL GROUP BY cell)""")
ORACLE["area_centered"] = with_tau(f"SELECT n, round(area, 2) + 0.0 AS area FROM ({_area('tau', True)})")
ORACLE["area_uncentered"] = with_tau(f"SELECT n, round(area, 2) + 0.0 AS area FROM ({_area('tau', False)})")
ORACLE["nauuc"] = with_tau(f"""
SELECT m.n, round(m.area, 2) + 0.0 AS area_model, round(o.area, 2) + 0.0 AS area_oracle,
       round(CASE WHEN abs(o.area) <= 1e-12 THEN NULL ELSE least(greatest(m.area / o.area, 0.0), 1.0) END, 6) + 0.0 AS nauuc
FROM ({_area('tau', True)}) m, ({_area('psi', True)}) o""")
ORACLE["nauuc_foldmean"] = with_tau(f"""
SELECT count(*) AS n_folds, round(avg(CASE WHEN o.area <= 0 THEN 0.0 ELSE least(greatest(m.area / o.area, 0.0), 1.0) END), 6) + 0.0 AS nauuc_mean
FROM ({_area('tau', False, part='fold')}) m JOIN ({_area('psi', False, part='fold')}) o USING (fold)""")
ORACLE["policy_at_k"] = with_tau("""
, rk AS (SELECT psi, row_number() OVER (ORDER BY tau DESC NULLS LAST, id) AS r, count(*) OVER () AS n
         FROM ht WHERE psi IS NOT NULL),
ks AS (SELECT * FROM (VALUES (10, CAST(0.1 AS DOUBLE)), (20, CAST(0.2 AS DOUBLE)), (30, CAST(0.3 AS DOUBLE))) v(k_pct, k))
SELECT ks.k_pct, CAST(greatest(1, floor(max(rk.n) * ks.k)) AS BIGINT) AS m,
       round(sum(CASE WHEN rk.r <= greatest(1, floor(rk.n * ks.k)) THEN rk.psi END), 2) + 0.0 AS policy_value
FROM rk, ks GROUP BY ks.k_pct, ks.k""")
ORACLE["gain_curve"] = with_tau("""
, rk AS (SELECT row_number() OVER (ORDER BY tau DESC NULLS LAST, id) AS r, count(*) OVER () AS n,
                sum(psi) OVER (ORDER BY tau DESC NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS cum
         FROM ht WHERE psi IS NOT NULL),
g AS (SELECT q, CAST(greatest(1, floor(n * q / 100.0)) AS BIGINT) AS m, n
      FROM range(1, 101) r(q), (SELECT max(n) AS n FROM rk))
SELECT CAST(g.q AS INTEGER) AS q, g.m, round(g.m / g.n, 6) + 0.0 AS coverage, round(rk.cum, 2) + 0.0 AS gain
FROM g JOIN rk ON rk.r = g.m""")
ORACLE["spearman"] = with_tau("""
, ra AS (SELECT id, rank() OVER (ORDER BY tau) + (count(*) OVER (PARTITION BY tau) - 1) / 2.0 AS a,
                rank() OVER (ORDER BY psi) + (count(*) OVER (PARTITION BY psi) - 1) / 2.0 AS b
         FROM ht WHERE tau IS NOT NULL AND psi IS NOT NULL)
SELECT count(*) AS n, round(corr(a, b), 6) + 0.0 AS spearman FROM ra""")
_PS = (0.1, 0.25, 0.5, 0.75, 0.9)
ORACLE["tau_quantiles"] = with_tau(", tq AS (SELECT round(tau, 6) AS tau, e FROM ht)\n" + "\nUNION ALL\n".join(
    f"SELECT '{scope}' AS scope, CAST({p} AS DOUBLE) AS p, round(quantile_cont(tau, {p}), 4) + 0.0 AS q "
    f"FROM tq {where}"
    for scope, where in (("full", ""), ("band", "WHERE e BETWEEN 0.2 AND 0.8")) for p in _PS))
ORACLE["tau_psi_corr"] = with_tau(
    "SELECT count(*) AS n, round(corr(tau, psi), 6) + 0.0 AS corr FROM ht WHERE e BETWEEN 0.3 AND 0.7")

# ------------------------------------------------------------ P4 robustness
RUNS = 100


def coef_sql(seed: int, salt: str | None = None) -> str:
    """Per-run permutation coefficients: ((run + 1)·m + o) mod …, with (m, o)
    from md5 of '<salt>:<name>' (computed here as literals)."""
    import hashlib

    salt = salt or f"perm{seed}"
    p = 2147483647
    out = []
    for c in ("a1", "b1", "c1", "a2", "b2", "c2"):
        hx = hashlib.md5(f"{salt}:{c}".encode()).hexdigest()
        m, o = int(hx[:15], 16) % (p - 1) + 1, int(hx[15:30], 16) % p
        v = f"((CAST(run AS BIGINT) + 1) * {m} + {o})"
        out.append(f"{v} % {p} AS {c}" if c.startswith("c") else f"{v} % {p - 1} + 1 AS {c}")
    return ", ".join(out)


def placebo_ctes(y: str, prefix: str = "", runs: int = RUNS, seed: int = SEED,
                 ps: tuple[float, float] = (PS_LO, PS_HI)) -> str:
    """Per-run cross-fit on an exactly permuted treatment (row_number per run)."""
    return f"""
, {prefix}n1t AS (SELECT count(CASE WHEN t = 1 THEN 1 END) AS n1 FROM {prefix}p),
{prefix}rc0 AS (SELECT run, {coef_sql(seed)} FROM range(0, {runs}) r(run)),
{prefix}rr AS (SELECT q.id, q.fold, q.cell, q.{y} AS yy, c.run,
              ((c.a1 * (q.h0 & 1073741823) + c.b1 * ((q.h0 >> 30) & 1073741823) + c.c1) % 2147483647) * 2147483648
              + (c.a2 * (q.h0 & 1073741823) + c.b2 * ((q.h0 >> 30) & 1073741823) + c.c2) % 2147483647 AS h
       FROM (SELECT *, {md5_int('id', f"'perm{seed}'")} AS h0 FROM {prefix}p) q, {prefix}rc0 c),
{prefix}pr AS (SELECT {prefix}rr.*, CASE WHEN row_number() OVER (PARTITION BY run ORDER BY h, id) <= (SELECT n1 FROM {prefix}n1t)
                    THEN 1 ELSE 0 END AS t FROM {prefix}rr),
{prefix}rk AS (SELECT DISTINCT run, fold, cell FROM {prefix}pr),
{prefix}rc AS (SELECT k.run, k.fold, k.cell,
              count(CASE WHEN q.t = 1 THEN 1 END) AS n1, count(CASE WHEN q.t = 0 THEN 1 END) AS n0,
              sum(CASE WHEN q.t = 1 THEN {cents('q.yy')} END) AS s1, sum(CASE WHEN q.t = 0 THEN {cents('q.yy')} END) AS s0
       FROM {prefix}rk k LEFT JOIN {prefix}pr q ON q.run = k.run AND q.cell = k.cell AND q.fold <> k.fold
       GROUP BY k.run, k.fold, k.cell),
{prefix}ra AS (SELECT f.run, f.fold,
              count(CASE WHEN q.t = 1 THEN 1 END) AS n1, count(CASE WHEN q.t = 0 THEN 1 END) AS n0,
              sum(CASE WHEN q.t = 1 THEN {cents('q.yy')} END) AS s1, sum(CASE WHEN q.t = 0 THEN {cents('q.yy')} END) AS s0
       FROM (SELECT DISTINCT run, fold FROM {prefix}pr) f LEFT JOIN {prefix}pr q ON q.run = f.run AND q.fold <> f.fold
       GROUP BY f.run, f.fold),
{prefix}ro AS (SELECT c.run, c.fold, c.cell,
    greatest(least(greatest(least(CASE WHEN c.n1 + c.n0 > 0 THEN CAST(c.n1 AS DOUBLE) / (c.n1 + c.n0)
         WHEN a.n1 + a.n0 > 0 THEN CAST(a.n1 AS DOUBLE) / (a.n1 + a.n0) ELSE 0.5 END, {1 - TRIM}), {TRIM}), {ps[1]}), {ps[0]}) AS e,
    CASE WHEN c.n1 > 0 THEN CAST(c.s1 AS DOUBLE) / 100.0 / c.n1
         WHEN a.n1 > 0 THEN CAST(a.s1 AS DOUBLE) / 100.0 / a.n1 ELSE 0.0 END AS mu1,
    CASE WHEN c.n0 > 0 THEN CAST(c.s0 AS DOUBLE) / 100.0 / c.n0
         WHEN a.n0 > 0 THEN CAST(a.s0 AS DOUBLE) / 100.0 / a.n0 ELSE 0.0 END AS mu0
  FROM {prefix}rc c JOIN {prefix}ra a ON a.run = c.run AND a.fold = c.fold),
{prefix}rp AS (SELECT {prefix}pr.run, {prefix}pr.t, {prefix}pr.yy AS y, {prefix}ro.e, {prefix}ro.mu1, {prefix}ro.mu0,
              {prefix}pr.t * ({prefix}pr.yy - {prefix}ro.mu1) / {prefix}ro.e - (1 - {prefix}pr.t) * ({prefix}pr.yy - {prefix}ro.mu0) / (1 - {prefix}ro.e) + ({prefix}ro.mu1 - {prefix}ro.mu0) AS psi
       FROM {prefix}pr JOIN {prefix}ro ON {prefix}ro.run = {prefix}pr.run AND {prefix}ro.fold = {prefix}pr.fold AND {prefix}ro.cell = {prefix}pr.cell),
{prefix}re AS (SELECT run, avg(psi) AS ate,
              avg(t * (y - mu0) - (1 - t) * (e / (1 - e)) * (y - mu0)) / (avg(t) + 1e-12) AS att,
              sum(4.0 * e * (1 - e) * psi) / (sum(4.0 * e * (1 - e)) + 1e-12) AS ato
       FROM {prefix}rp GROUP BY run)"""


ORACLE["placebo_strata"] = with_customer(placebo_ctes("y") + """
SELECT CAST(run AS INTEGER) AS run, round(ate, 4) + 0.0 AS ate, round(att, 4) + 0.0 AS att,
       round(ato, 4) + 0.0 AS ato FROM re""")
ORACLE["placebo_pvalue"] = with_customer(placebo_ctes("y") + """
, ob AS (SELECT avg(psi) AS est FROM nu)
SELECT round(max(ob.est), 4) + 0.0 AS est, count(*) AS runs,
       count(CASE WHEN abs(re.ate) >= abs(ob.est) THEN 1 END) AS n_extreme,
       round((count(CASE WHEN abs(re.ate) >= abs(ob.est) THEN 1 END) + 1) / (count(*) + 1), 6) + 0.0 AS p_value
FROM re, ob""")
ORACLE["negctrl_strata"] = f"WITH {strata_ctes(PANEL_CUSTOMER, CUSTOMER_CELL, 'y_nc')}" + placebo_ctes("y_nc") + """
, ob AS (SELECT avg(psi) AS est FROM nu)
SELECT round(max(ob.est), 4) + 0.0 AS est_nc, count(*) AS runs,
       count(CASE WHEN abs(re.ate) >= abs(ob.est) THEN 1 END) AS n_extreme,
       round((count(CASE WHEN abs(re.ate) >= abs(ob.est) THEN 1 END) + 1) / (count(*) + 1), 6) + 0.0 AS p_nc
FROM re, ob"""

ORACLE["verdict_flags"] = f"""
WITH o AS ({ORACLE['ovl_overlap']}),
k AS ({ORACLE['ks_overlap']}),
s AS ({with_customer(_smd('ATE') + ' SELECT max(abs(smd)) AS smd_max FROM sd')}),
pl AS ({ORACLE['placebo_pvalue']}),
nc AS ({ORACLE['negctrl_strata']}),
f AS (SELECT o.ovl, k.ks, s.smd_max, pl.p_value AS placebo_p, nc.p_nc AS negctrl_p,
             coalesce(o.ovl >= 0.5 AND k.ks <= 0.4, false) AS overlap_pass,
             coalesce(s.smd_max <= 0.1, false) AS balance_pass,
             coalesce(pl.p_value >= 0.1, false) AS placebo_pass,
             coalesce(nc.p_nc >= 0.1, true) AS negctrl_pass
      FROM o, k, s, pl, nc)
SELECT round(ovl, 6) + 0.0 AS ovl, round(ks, 6) + 0.0 AS ks, round(smd_max, 6) + 0.0 AS smd_max,
       placebo_p, negctrl_p, overlap_pass, balance_pass, placebo_pass, negctrl_pass,
       CAST(overlap_pass AS INTEGER) + CAST(balance_pass AS INTEGER) + CAST(placebo_pass AS INTEGER)
         + CAST(negctrl_pass AS INTEGER) AS n_pass,
       CASE WHEN CAST(overlap_pass AS INTEGER) + CAST(balance_pass AS INTEGER) + CAST(placebo_pass AS INTEGER)
                 + CAST(negctrl_pass AS INTEGER) = 4 THEN 'credible'
            WHEN CAST(overlap_pass AS INTEGER) + CAST(balance_pass AS INTEGER) + CAST(placebo_pass AS INTEGER)
                 + CAST(negctrl_pass AS INTEGER) >= 2 THEN 'doubtful' ELSE 'fail' END AS verdict,
       placebo_p <= 0.1 AS perm_significant
FROM f"""

ORACLE["placebo_orders"] = f"WITH {strata_ctes(PANEL_ORDERS, ORDER_CELL)}" + placebo_ctes("y") + \
    "\nSELECT CAST(run AS INTEGER) AS run, round(ate, 4) + 0.0 AS ate FROM re"

# ------------------------------------------------------------ P5 features
DOCS = f"""
SELECT l.doc_id AS id, l.quality, l.toxic,
       coalesce(CAST(d.lang AS VARCHAR), '__NA__') AS lang, coalesce(CAST(d.source AS VARCHAR), '__NA__') AS source,
       CAST({md5_int('l.doc_id', "'42'")} % 5 AS INTEGER) AS fold
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""

TE_CTES = f"""
WITH d AS ({DOCS}),
gm AS (SELECT avg(CAST(quality = 1 AS DOUBLE)) AS gm FROM d WHERE quality IS NOT NULL),
lv AS (SELECT 'lang' AS col, lang AS level, fold, quality FROM d
       UNION ALL SELECT 'source' AS col, source AS level, fold, quality FROM d),
grid AS (SELECT k.col, k.level, CAST(f.range AS INTEGER) AS fold
         FROM (SELECT DISTINCT col, level FROM lv) k CROSS JOIN range(5) f),
te AS (SELECT g.col, g.level, g.fold,
              CASE WHEN count(q.quality) > 0
                   THEN (sum(CAST(q.quality = 1 AS DOUBLE)) + max(gm.gm) * 20.0) / (count(q.quality) + 20.0) END AS te
       FROM grid g CROSS JOIN gm
       LEFT JOIN lv q ON q.col = g.col AND q.level = g.level AND q.fold <> g.fold
       GROUP BY g.col, g.level, g.fold)"""

ORACLE["te_oof"] = TE_CTES + """
SELECT d.id, round(coalesce(tl.te, gm.gm), 6) + 0.0 AS lang__te, round(coalesce(ts.te, gm.gm), 6) + 0.0 AS source__te
FROM d CROSS JOIN gm
LEFT JOIN te tl ON tl.col = 'lang' AND tl.level = d.lang AND tl.fold = d.fold
LEFT JOIN te ts ON ts.col = 'source' AND ts.level = d.source AND ts.fold = d.fold"""
ORACLE["te_map"] = TE_CTES + """
SELECT col, level, round(avg(te), 6) + 0.0 AS te, count(*) AS n_folds FROM te WHERE te IS NOT NULL GROUP BY col, level"""

ORACLE["count_freq"] = """
WITH d AS (SELECT doc_id AS id, coalesce(CAST(lang AS VARCHAR), '__NA__') AS lang,
                  coalesce(CAST(source AS VARCHAR), '__NA__') AS source FROM documents),
n AS (SELECT count(*) AS n FROM d),
cl AS (SELECT lang, count(*) AS c FROM d GROUP BY lang),
cs AS (SELECT source, count(*) AS c FROM d GROUP BY source)
SELECT d.id, CAST(cl.c AS DOUBLE) AS lang__count, CAST(cl.c AS DOUBLE) / greatest(n.n, 1) AS lang__freq,
       CAST(cs.c AS DOUBLE) AS source__count, CAST(cs.c AS DOUBLE) / greatest(n.n, 1) AS source__freq
FROM d CROSS JOIN n JOIN cl USING (lang) JOIN cs USING (source)"""

ORACLE["woe"] = f"""
WITH d AS ({DOCS}),
tot AS (SELECT count(CASE WHEN quality = 1 THEN 1 END) AS t1, count(CASE WHEN quality = 0 THEN 1 END) AS t0 FROM d),
lv AS (SELECT 'lang' AS col, lang AS level, quality FROM d WHERE quality IS NOT NULL
       UNION ALL SELECT 'source' AS col, source AS level, quality FROM d WHERE quality IS NOT NULL),
per AS (SELECT col, level, count(CASE WHEN quality = 1 THEN 1 END) AS n1,
               count(CASE WHEN quality = 0 THEN 1 END) AS n0 FROM lv GROUP BY col, level)
SELECT col, level, n1, n0,
       round(CASE WHEN n1 > 0 AND n0 > 0 THEN ln((n1 / t1) / (n0 / t0)) END, 6) + 0.0 AS woe
FROM per CROSS JOIN tot"""

ORACLE["binary_target"] = f"""
SELECT count(DISTINCT quality) AS n_distinct, min(quality) AS lo, max(quality) AS hi,
       count(DISTINCT quality) <= 2 AND min(quality) IN (0, 1) AND max(quality) IN (0, 1) AS is_binary
FROM ({DOCS})"""

_GKEYS = [["seg"], ["region", "seg"]]
_GNUMS = ["acctbal", "before_amt"]


def _group_agg_sql() -> str:
    ctes, joins, cols = [], [], []
    for i, keys in enumerate(_GKEYS):
        kname = "__".join(keys)
        parts = []
        for n in _GNUMS:
            pre = f"grp_{kname}__{n}__"
            parts += [f"avg({n}) AS {pre}mean", f"median({n}) AS {pre}median",
                      f"stddev_samp({n}) AS {pre}std", f"CAST(count({n}) AS DOUBLE) AS {pre}count",
                      f"CAST(count(DISTINCT {n}) AS DOUBLE) AS {pre}nunique"]
            cols += [f"round(g{i}.{pre}{f}, 4) + 0.0 AS {pre}{f}"
                     for f in ("mean", "median", "std", "count", "nunique")]
        ctes.append(f"g{i} AS (SELECT {', '.join(keys)}, {', '.join(parts)} FROM p GROUP BY {', '.join(keys)})")
        cond = " AND ".join(f"p.{k} IS NOT DISTINCT FROM g{i}.{k}" for k in keys)
        joins.append(f"LEFT JOIN g{i} ON {cond}")
    return (f"WITH p AS ({PANEL_CUSTOMER}),\n" + ",\n".join(ctes)
            + f"\nSELECT p.id, {', '.join(cols)} FROM p " + " ".join(joins))


ORACLE["group_agg"] = _group_agg_sql()


def _num_derive_sql() -> str:
    nums = ["before_cnt", "before_amt", "acctbal", "y_nc"]
    x = {c: f"CAST({c} AS DOUBLE)" for c in nums}
    cols = [f"round(CASE WHEN {x[c]} IS NOT NULL THEN ln(1 + greatest({x[c]}, 0.0)) END, 6) + 0.0 AS {c}__log1p"
            for c in nums]
    cols += [f"{x[a]} / nullif({x['before_cnt']}, 0.0) AS ratio__{a}__per__before_cnt" for a in nums[1:]]
    for i, a in enumerate(nums):
        for b in nums[i + 1:]:
            cols.append(f"{x[a]} * {x[b]} AS inter__{a}__x__{b}")
            cols.append(f"{x[a]} / nullif({x[b]}, 0.0) AS inter__{a}__div__{b}")
    return f"SELECT id, {', '.join(cols)} FROM ({PANEL_CUSTOMER})"


ORACLE["num_derive"] = _num_derive_sql()


def _qbin_sql() -> str:
    cols = []
    ctes = []
    for c in ("acctbal", "before_amt"):
        qs = ", ".join(f"quantile_cont({c}, {i / 10}) AS q{i}" for i in range(1, 10))
        ctes.append(f"c_{c} AS (SELECT DISTINCT unnest([{', '.join(f'q{i}' for i in range(1, 10))}]) AS cut "
                    f"FROM (SELECT {qs} FROM p))")
        idx = f"(SELECT count(*) FROM c_{c} WHERE cut < p.{c})"
        for k in range(10):
            cols.append(f"CASE WHEN p.{c} IS NOT NULL AND {idx} = {k} THEN 1 ELSE 0 END AS {c}__qbin_{k}")
        cols.append(f"CASE WHEN p.{c} IS NULL THEN 1 ELSE 0 END AS {c}__qbin_nan")
    return (f"WITH p AS ({PANEL_CUSTOMER}),\n" + ",\n".join(ctes)
            + f"\nSELECT p.id, {', '.join(cols)} FROM p")


ORACLE["qbin"] = _qbin_sql()


def _poly2_sql() -> str:
    nums = ["before_cnt", "before_amt", "acctbal"]
    xs = [f"coalesce(CAST({c} AS DOUBLE), 0.0)" for c in nums]
    terms = list(xs) + [f"{xs[i]} * {xs[j]}" for i in range(len(xs)) for j in range(i, len(xs))]
    return f"SELECT id, {', '.join(f'{t} AS poly2_{k}' for k, t in enumerate(terms))} FROM ({PANEL_CUSTOMER})"


ORACLE["poly2"] = _poly2_sql()


def _col_score_sql() -> str:
    parts = []
    for c in ("before_cnt", "before_amt", "acctbal", "region"):
        x = f"coalesce(CAST({c} AS DOUBLE), 0.0)"
        corr = f"coalesce(covar_pop({x}, y) / ((stddev_samp(y) + 1e-12) * (stddev_samp({x}) + 1e-12)), 0.0)"
        parts.append(f"SELECT '{c}' AS feature, round({corr}, 6) + 0.0 AS corr, "
                     f"round(stddev_samp({x}), 4) + 0.0 AS std, "
                     f"round(0.7 * abs({corr}) + 0.3 * (stddev_samp({x}) + 1e-12), 4) + 0.0 AS score FROM p")
    return f"WITH p AS ({PANEL_CUSTOMER})\n" + "\nUNION ALL\n".join(parts)


ORACLE["col_score"] = _col_score_sql()

# ------------------------------------------------------------ P7 campaign
CAMP_PS = (0.05, 0.95)
CAMP_SEED = 2025
CAMP_K = 3
_PANEL_COLS = "id, t, y, y_nc, before_cnt, before_amt, seg, region, acctbal"


def campaign_sql(panel_sql: str, activity: str | None, tail: str = "result") -> str:
    lit = "CAST(NULL AS VARCHAR)" if activity is None else f"'{activity}'"
    a = strata_ctes(panel_sql, CUSTOMER_CELL, "y", "a_", CAMP_SEED, CAMP_K, CAMP_PS)
    ap = placebo_ctes("y", "a_", 5, CAMP_SEED, CAMP_PS)
    band = f"SELECT {_PANEL_COLS} FROM a_nu WHERE e BETWEEN 0.2 AND 0.8"
    b = strata_ctes(band, CUSTOMER_CELL, "y", "b_", CAMP_SEED, CAMP_K, CAMP_PS)
    bp = placebo_ctes("y", "b_", 10, CAMP_SEED, CAMP_PS)
    qs = ", ".join(f"quantile_cont(tau, {p}) AS p{int(round(p * 100))}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))
    body = f"""
, ate AS (SELECT count(*) AS n, count(CASE WHEN t = 1 THEN 1 END) AS n1, count(CASE WHEN t = 0 THEN 1 END) AS n0,
                 avg(psi) AS est, stddev_samp(psi) / sqrt(count(*)) AS se FROM a_nu),
ate_p AS (SELECT (count(CASE WHEN abs(r.ate) >= abs(ate.est) THEN 1 END) + 1) / (count(*) + 1) AS p FROM a_re r, ate),
att_a AS (SELECT *, t * (y - mu0) - (1 - t) * (e / (1 - e)) * (y - mu0) AS term FROM b_nu),
att_s AS (SELECT avg(t) AS p1, avg(term) / (avg(t) + 1e-12) AS est FROM att_a),
att AS (SELECT max(s.est) AS est,
               stddev_samp(a.term / (s.p1 + 1e-12) - s.est * ((a.t - s.p1) / (s.p1 + 1e-12))) / sqrt(count(*)) AS se
        FROM att_a a, att_s s),
att_p AS (SELECT (count(CASE WHEN abs(r.att) >= abs(att.est) THEN 1 END) + 1) / (count(*) + 1) AS p FROM b_re r, att),
kept AS (SELECT count(CASE WHEN e BETWEEN 0.2 AND 0.8 AND t = 1 THEN 1 END) AS kept,
                count(CASE WHEN t = 1 THEN 1 END) AS total FROM a_nu),
qf AS (SELECT {qs} FROM a_ht),
qb AS (SELECT {qs} FROM a_ht WHERE e BETWEEN 0.2 AND 0.8)"""
    z = Z975
    if tail == "uplift":
        sel = f"""
SELECT {lit} AS activity_uuid, id AS identity, t AS t_col, 'y' AS y_col,
       '2026-01-01T00:00:00Z' AS created_at, round(tau, 4) + 0.0 AS tau_hat, psi FROM a_ht WHERE t = 1"""
    else:
        m = lambda x, c: f"round({x}, 4) + 0.0 AS {c}"
        sel = f"""
SELECT {lit} AS activity_id, ate.n AS n_samples, ate.n1 AS n_treated, ate.n0 AS n_control,
       kept.kept AS treated_kept, kept.total AS treated_total,
       {m('ate.est', 'ate_point')}, {m('ate.se', 'ate_se')}, {m(f'ate.est - {z} * ate.se', 'ate_ci_lo')},
       {m(f'ate.est + {z} * ate.se', 'ate_ci_hi')}, {m('att.est', 'att_point')}, {m('att.se', 'att_se')},
       {m(f'att.est - {z} * att.se', 'att_ci_lo')}, {m(f'att.est + {z} * att.se', 'att_ci_hi')},
       {', '.join(m(f'qf.p{p}', f'tau_p{p}') for p in (10, 25, 50, 75, 90))},
       {', '.join(m(f'qb.p{p}', f'tau_band_p{p}') for p in (10, 25, 50, 75, 90))},
       round(ate_p.p, 6) + 0.0 AS ate_placebo_p, round(att_p.p, 6) + 0.0 AS att_placebo_p,
       round(CASE WHEN kept.total > 0 THEN kept.kept / kept.total END, 6) + 0.0 AS treated_coverage
FROM ate, ate_p, att, att_p, kept, qf, qb"""
    return f"WITH {a}{ap},\n{b}{bp}{tau_ctes('a_', (0.2, 0.8), CAMP_K)}{body}{sel}"


ORACLE["campaign_result"] = campaign_sql(PANEL_CUSTOMER, "cust-1998")
ORACLE["user_uplift"] = campaign_sql(PANEL_CUSTOMER, "cust-1998", "uplift")
ORACLE["campaign_batch"] = "\nUNION ALL\n".join(
    f"SELECT * FROM ({campaign_sql(f'SELECT * FROM ({PANEL_CUSTOMER}) WHERE seg = {chr(39)}{s}{chr(39)}', s)})"
    for s in SEG_LEVELS)

# ------------------------------------------------------------ P8 documented extras
ORACLE["cuped"] = with_customer("""
, tr AS (SELECT f.fold, regr_slope(q.y, q.before_amt) AS theta, avg(q.before_amt) AS xm
         FROM (SELECT DISTINCT fold FROM p) f JOIN p q ON q.fold <> f.fold GROUP BY f.fold),
cu AS (SELECT p.t, p.y, p.y - coalesce(tr.theta, 0.0) * (p.before_amt - tr.xm) AS yc FROM p JOIN tr USING (fold))
SELECT count(*) AS n,
       round(avg(CASE WHEN t = 1 THEN y END) - avg(CASE WHEN t = 0 THEN y END), 4) + 0.0 AS diff,
       round(avg(CASE WHEN t = 1 THEN yc END) - avg(CASE WHEN t = 0 THEN yc END), 4) + 0.0 AS diff_cuped,
       round(1 - var_samp(yc) / var_samp(y), 6) + 0.0 AS var_reduction FROM cu""")

SEEN_Y = f"SELECT * REPLACE (CASE WHEN acctbal > 0 THEN y END AS y) FROM ({PANEL_CUSTOMER})"
ORACLE["ipcw"] = f"""WITH {strata_ctes(SEEN_Y, CUSTOMER_CELL)},
ob AS (SELECT nu.*, CASE WHEN acctbal > 0 THEN 1 ELSE 0 END AS r FROM nu),
pc AS (SELECT k.fold, k.cell, k.t, sum(q.r) AS o, count(q.r) AS m
       FROM (SELECT DISTINCT fold, cell, t FROM ob) k
       LEFT JOIN ob q ON q.cell = k.cell AND q.t = k.t AND q.fold <> k.fold GROUP BY k.fold, k.cell, k.t),
pa AS (SELECT f.fold, sum(q.r) AS o, count(q.r) AS m
       FROM (SELECT DISTINCT fold FROM ob) f LEFT JOIN ob q ON q.fold <> f.fold GROUP BY f.fold),
pp AS (SELECT pc.fold, pc.cell, pc.t, greatest(CASE WHEN pc.m > 0 THEN pc.o / pc.m WHEN pa.m > 0 THEN pa.o / pa.m
                                                    ELSE 1.0 END, 0.01) AS pi
       FROM pc JOIN pa USING (fold)),
dr AS (SELECT ob.r, mu1 - mu0 + CASE WHEN ob.r = 1
              THEN (ob.t * (y - mu1) / e - (1 - ob.t) * (y - mu0) / (1 - e)) / pp.pi ELSE 0.0 END AS inf
       FROM ob JOIN pp USING (fold, cell, t))
SELECT count(*) AS n, sum(r)::BIGINT AS n_observed, round(avg(inf), 4) + 0.0 AS est_ipcw,
       round(stddev_samp(inf) / sqrt(count(*)), 4) + 0.0 AS se_ipcw FROM dr"""

ORACLE["tmle"] = with_customer("""
, ep AS (SELECT sum((t / e - (1 - t) / (1 - e)) * (y - CASE WHEN t = 1 THEN mu1 ELSE mu0 END))
                / sum((t / e - (1 - t) / (1 - e)) * (t / e - (1 - t) / (1 - e))) AS eps FROM nu),
up AS (SELECT nu.t, nu.y, nu.e, nu.mu1 + ep.eps / nu.e AS m1, nu.mu0 - ep.eps / (1 - nu.e) AS m0, ep.eps FROM nu, ep),
ag AS (SELECT count(*) AS n, max(eps) AS eps, avg(m1 - m0) AS est,
              stddev_samp(t * (y - m1) / e - (1 - t) * (y - m0) / (1 - e) + (m1 - m0)) / sqrt(count(*)) AS se FROM up)
SELECT n, round(eps, 4) + 0.0 AS epsilon, round(est, 4) + 0.0 AS est, round(se, 4) + 0.0 AS se,
       round(est - 1.959963984540054 * se, 4) + 0.0 AS ci_lo, round(est + 1.959963984540054 * se, 4) + 0.0 AS ci_hi
FROM ag""")

ORACLE["uplift_curve"] = with_tau("""
, rk AS (SELECT row_number() OVER (ORDER BY tau DESC NULLS LAST, id) AS r, count(*) OVER () AS n,
                sum(psi) OVER (ORDER BY tau DESC NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS cum
         FROM ht WHERE psi IS NOT NULL),
g AS (SELECT q, CAST(greatest(1, floor(n * q / 100.0)) AS BIGINT) AS m
      FROM range(5, 101, 5) r(q), (SELECT max(n) AS n FROM rk))
SELECT CAST(g.q AS INTEGER) AS q, g.m, round(rk.cum / g.m, 4) + 0.0 AS mean_uplift FROM g JOIN rk ON rk.r = g.m""")

ORACLE["qini_curve"] = with_tau("""
, rk AS (SELECT row_number() OVER w AS r, count(*) OVER () AS n,
                sum(t * y) OVER (w ROWS UNBOUNDED PRECEDING) AS y1, sum((1 - t) * y) OVER (w ROWS UNBOUNDED PRECEDING) AS y0,
                sum(t) OVER (w ROWS UNBOUNDED PRECEDING) AS n1, sum(1 - t) OVER (w ROWS UNBOUNDED PRECEDING) AS n0
         FROM ht WHERE y IS NOT NULL WINDOW w AS (ORDER BY tau DESC NULLS LAST, id)),
g AS (SELECT q, CAST(greatest(1, floor(n * q / 100.0)) AS BIGINT) AS m
      FROM range(1, 101) r(q), (SELECT max(n) AS n FROM rk))
SELECT CAST(g.q AS INTEGER) AS q, g.m,
       round(rk.y1 - rk.y0 * rk.n1 / CASE WHEN rk.n0 > 0 THEN rk.n0 END, 2) + 0.0 AS qini
FROM g JOIN rk ON rk.r = g.m""")

ORACLE["trim_sensitivity"] = with_customer("\nUNION ALL\n".join(
    f"SELECT CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi, count(*) AS n_kept, "
    f"round(avg(psi), 4) + 0.0 AS est, round(stddev_samp(psi) / sqrt(count(*)), 4) + 0.0 AS se, "
    f"max(abs(psi)) AS psi_abs_max, round(quantile_cont(abs(psi), 0.95), 4) + 0.0 AS psi_p95, "
    f"round(quantile_cont(abs(psi), 0.99), 4) + 0.0 AS psi_p99 FROM nu WHERE e BETWEEN {lo} AND {hi}"
    for lo, hi in ((0.01, 0.99), (0.05, 0.95), (0.1, 0.9), (0.2, 0.8))))

# ------------------------------------------------------------ P6 learners and HTE
ORACLE["crossfit_linear1"] = with_customer("""
, ft AS (SELECT f.fold, a.arm, regr_intercept(q.y, q.before_amt) AS b0, regr_slope(q.y, q.before_amt) AS b1
         FROM (SELECT DISTINCT fold FROM p) f CROSS JOIN (VALUES (0), (1)) a(arm)
         LEFT JOIN p q ON q.fold <> f.fold AND q.t = a.arm GROUP BY f.fold, a.arm)
SELECT p.id, p.fold, round(m1.b0 + m1.b1 * p.before_amt, 4) + 0.0 AS mu1,
       round(m0.b0 + m0.b1 * p.before_amt, 4) + 0.0 AS mu0
FROM p JOIN ft m1 ON m1.fold = p.fold AND m1.arm = 1 JOIN ft m0 ON m0.fold = p.fold AND m0.arm = 0""")

ORACLE["label_shares"] = with_customer("""
, se AS (SELECT cell, avg(psi) AS tau, stddev_samp(psi) / sqrt(count(*)) AS se FROM nu WHERE psi IS NOT NULL GROUP BY cell),
lb AS (SELECT cell, tau - 2.5758293035489004 * se AS lb99, tau - 1.6448536269514722 * se AS lb90 FROM se),
lab AS (SELECT CASE WHEN lb.lb99 > 0 THEN 'strong' WHEN lb.lb90 > 0 THEN 'medium' ELSE 'none' END AS label
        FROM nu LEFT JOIN lb USING (cell) WHERE nu.t = 1)
SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM lab GROUP BY label""")

# ------------------------------------------------------------ P7 distillation
_LEAF = ("region * 3 + CASE WHEN CAST(before_cnt AS DOUBLE) <= 1.0 THEN 0 "
         "WHEN CAST(before_cnt AS DOUBLE) <= 3.0 THEN 1 ELSE 2 END")
ORACLE["rule_apply"] = with_tau(f"SELECT id, CAST({_LEAF} AS INTEGER) AS leaf FROM ht")
ORACLE["rule_value"] = with_tau(f"""
, lv AS (SELECT CAST({_LEAF} AS INTEGER) AS leaf, tau, psi FROM ht)
SELECT leaf, count(*) AS n, round(count(*) / (SELECT count(*) FROM lv), 6) + 0.0 AS coverage,
       round(avg(tau), 4) + 0.0 AS uplift, round(sum(psi), 2) + 0.0 AS value FROM lv GROUP BY leaf""")


def _boot_sql(reps: int = 200, salt: str = "boot") -> str:
    import math as _m

    cdfs, cdf, p = [], 0.0, _m.exp(-1.0)
    for i in range(10):
        cdf += p
        cdfs.append(cdf)
        p = p / (i + 1)
    w = " + ".join(f"CASE WHEN u > {c!r} THEN 1 ELSE 0 END" for c in cdfs)
    h0 = md5_int("id", f"'{salt}'")
    key = ("((c.a1 * (q.h0 & 1073741823) + c.b1 * ((q.h0 >> 30) & 1073741823) + c.c1) % 2147483647) * 2147483648"
           " + (c.a2 * (q.h0 & 1073741823) + c.b2 * ((q.h0 >> 30) & 1073741823) + c.c2) % 2147483647")
    return with_tau(f"""
, lv AS (SELECT id, CAST({_LEAF} AS INTEGER) AS leaf, tau, {h0} AS h0 FROM ht),
bc AS (SELECT run, {coef_sql(0, salt)} FROM range(0, {reps}) r(run)),
bu AS (SELECT q.leaf, q.tau, c.run AS rep, ({key}) / 4611686018427387904.0 AS u FROM lv q, bc c),
bw AS (SELECT leaf, tau, rep, {w} AS w FROM bu),
bm AS (SELECT leaf, rep, CASE WHEN sum(w) > 0 THEN sum(w * tau) / sum(w) END AS m FROM bw GROUP BY leaf, rep)
SELECT leaf, round(quantile_cont(m, 0.05), 4) + 0.0 AS lo90, round(quantile_cont(m, 0.95), 4) + 0.0 AS hi90
FROM bm WHERE m IS NOT NULL GROUP BY leaf""")


ORACLE["rule_bootstrap"] = _boot_sql()
ORACLE["oof_r2_linear"] = with_customer("""
, ft AS (SELECT f.fold, regr_intercept(q.psi, q.before_amt) AS b0, regr_slope(q.psi, q.before_amt) AS b1
         FROM (SELECT DISTINCT fold FROM nu) f LEFT JOIN nu q ON q.fold <> f.fold GROUP BY f.fold),
pr AS (SELECT nu.psi, ft.b0 + ft.b1 * nu.before_amt AS ph FROM nu JOIN ft USING (fold))
SELECT count(*) AS n, round(1 - sum((psi - ph) * (psi - ph)) / sum((psi - (SELECT avg(psi) FROM pr)) * (psi - (SELECT avg(psi) FROM pr))), 6) + 0.0 AS r2_oof
FROM pr""")

# ------------------------------------------------------------ sources, recoding
ORACLE["scan_campaigns"] = "SELECT o_orderkey, o_totalprice, 'orders' AS activity_id FROM orders"
ORACLE["recode_onehot"] = f"""
SELECT id, t, y, round(ln(1 + before_amt), 6) + 0.0 AS before_amt_log1p,
       {', '.join(f"CASE WHEN seg = '{v}' THEN 1 ELSE 0 END AS seg_{v}" for v in SEG_LEVELS[1:])},
       {', '.join(f"CASE WHEN CAST(region AS VARCHAR) = '{v}' THEN 1 ELSE 0 END AS region_{v}" for v in range(1, 5))}
FROM ({PANEL_CUSTOMER})"""
ORACLE["complete_cases"] = """
SELECT d.lang, count(*) AS n, CAST(sum(l.quality) AS BIGINT) AS n_quality
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE d.doc_id IS NOT NULL AND d.lang IS NOT NULL AND d.source IS NOT NULL AND d.n_chars IS NOT NULL
  AND l.quality IS NOT NULL
GROUP BY d.lang"""

# ------------------------------------------------------------ cleaning
ORACLE["median_impute"] = f"""
WITH p AS (SELECT id, CASE WHEN y > 0 THEN y END AS y_obs FROM ({PANEL_CUSTOMER}))
SELECT id, round(coalesce(y_obs, (SELECT median(y_obs) FROM p)), 4) + 0.0 AS y_imputed FROM p"""
ORACLE["band_choice"] = with_customer("""
, s AS (SELECT count(CASE WHEN e BETWEEN 0.3 AND 0.7 THEN 1 END) AS n_band,
               count(CASE WHEN e BETWEEN 0.3 AND 0.7 AND t = 1 THEN 1 END) AS n_band_treated,
               count(CASE WHEN e BETWEEN 0.3 AND 0.7 AND t = 0 THEN 1 END) AS n_band_control,
               count(*) AS n FROM nu),
c AS (SELECT *, CASE WHEN n_band < 50 OR n_band_treated = 0 OR n_band_control = 0 THEN 'all'
                     WHEN n_band < 100 THEN 'base' ELSE 'band' END AS choice FROM s)
SELECT n, n_band, n_band_treated, n_band_control, choice,
       CASE WHEN choice = 'all' THEN 'band too small or one arm' END AS note,
       CASE WHEN choice = 'band' THEN 0.3 WHEN choice = 'base' THEN 0.1 ELSE 0.0 END AS lo,
       CASE WHEN choice = 'band' THEN 0.7 WHEN choice = 'base' THEN 0.9 ELSE 1.0 END AS hi
FROM c""")
ORACLE["hte_verdict"] = with_tau(f"""
, nn AS ({_area('tau', True)}), oo AS ({_area('psi', True)}),
v AS (SELECT nn.n, CASE WHEN abs(oo.area) <= 1e-12 THEN NULL ELSE least(greatest(nn.area / oo.area, 0.0), 1.0) END AS x
      FROM nn, oo)
SELECT n, round(x, 6) + 0.0 AS nauuc, coalesce(x >= 0.35, false) AS usable FROM v""")

# ------------------------------------------------------------ event-log panel
PANEL_EVENTS = f"""
SELECT user_id AS id,
       CAST(count(CASE WHEN ts < TIMESTAMP '2024-01-16' AND event_type = 'click' THEN 1 END)
            > count(CASE WHEN ts < TIMESTAMP '2024-01-16' AND event_type = 'view' THEN 1 END) AS INTEGER) AS t,
       coalesce(CAST(sum(CASE WHEN ts >= TIMESTAMP '2024-01-16' AND event_type = 'purchase'
                              THEN {cents('value')} END) AS DOUBLE) / CAST(100 AS DOUBLE), CAST(0 AS DOUBLE)) AS y,
       count(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 END) AS before_cnt,
       coalesce(CAST(sum(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN {cents('value')} END) AS DOUBLE)
                / CAST(100 AS DOUBLE), CAST(0 AS DOUBLE)) AS before_amt,
       count(CASE WHEN ts < TIMESTAMP '2024-01-16' AND event_type = 'click' THEN 1 END) AS before_clicks,
       count(CASE WHEN ts < TIMESTAMP '2024-01-16' AND event_type = 'view' THEN 1 END) AS before_views
FROM events GROUP BY user_id"""
EVENT_CELL = "least(floor(before_cnt / 25), 3)"
ORACLE["panel_events"] = PANEL_EVENTS
ORACLE["ate_events_strata"] = f"WITH {strata_ctes(PANEL_EVENTS, EVENT_CELL)}\n{effect_select('nu', 'ATE')}"

ORACLE["campaign_report"] = f"""
WITH r AS ({campaign_sql(PANEL_CUSTOMER, "cust-1998")}),
d AS (SELECT activity_id, COLUMNS(* EXCLUDE (activity_id))::DOUBLE FROM r)
SELECT activity_id, 'result' AS section, key, value
FROM (UNPIVOT d ON COLUMNS(* EXCLUDE (activity_id)) INTO NAME key VALUE value)"""

DOCS_STRAT = f"""
SELECT id, quality, toxic, lang, source,
       CAST((row_number() OVER (PARTITION BY CAST(quality AS INTEGER) ORDER BY {md5_int('id', "'42'")}, id) - 1) % 5
            AS INTEGER) AS fold
FROM (SELECT l.doc_id AS id, l.quality, l.toxic,
             coalesce(CAST(d.lang AS VARCHAR), '__NA__') AS lang, coalesce(CAST(d.source AS VARCHAR), '__NA__') AS source
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
ORACLE["te_oof_stratified"] = TE_CTES.replace(f"WITH d AS ({DOCS})", f"WITH d AS ({DOCS_STRAT})") + """
SELECT d.id, d.fold, round(coalesce(tl.te, gm.gm), 6) + 0.0 AS lang__te, round(coalesce(ts.te, gm.gm), 6) + 0.0 AS source__te
FROM d CROSS JOIN gm
LEFT JOIN te tl ON tl.col = 'lang' AND tl.level = d.lang AND tl.fold = d.fold
LEFT JOIN te ts ON ts.col = 'source' AND ts.level = d.source AND ts.fold = d.fold"""

ORACLE["att_band"] = f"""WITH {strata_ctes(PANEL_CUSTOMER, CUSTOMER_CELL)},
{strata_ctes(f"SELECT {_PANEL_COLS} FROM nu WHERE e BETWEEN 0.2 AND 0.8", CUSTOMER_CELL, prefix='b_')},
kept AS (SELECT count(CASE WHEN e BETWEEN 0.2 AND 0.8 AND t = 1 THEN 1 END) AS treated_kept,
                count(CASE WHEN t = 1 THEN 1 END) AS treated_total FROM nu)
SELECT x.*, kept.treated_kept, kept.treated_total FROM ({effect_select('b_nu', 'ATT')}) x, kept"""


# ------------------------------------------------------------ missing outcomes, NULL groups, string ids
MISSING_Y = f"""SELECT * REPLACE (CASE WHEN (t = 1 AND id % 10 = 0) OR (t = 0 AND id % 10 < 7) THEN NULL ELSE y END AS y)
FROM ({PANEL_CUSTOMER})"""
ORACLE["ate_null_y"] = f"WITH {strata_ctes(MISSING_Y, CUSTOMER_CELL)}\n{effect_select('nu', 'ATE')}"
ORACLE["att_null_y"] = f"WITH {strata_ctes(MISSING_Y, CUSTOMER_CELL)}\n{effect_select('nu', 'ATT')}"
ORACLE["ato_null_y"] = f"WITH {strata_ctes(MISSING_Y, CUSTOMER_CELL)}\n{effect_select('nu', 'ATO')}"
ORACLE["placebo_null_y"] = f"""WITH {strata_ctes(f"SELECT * FROM ({MISSING_Y}) WHERE y IS NOT NULL", CUSTOMER_CELL)}
{placebo_ctes("y", runs=20)}
SELECT run, round(ate, 4) + 0.0 AS ate, round(att, 4) + 0.0 AS att, round(ato, 4) + 0.0 AS ato FROM re"""

RANKED = f"""SELECT CASE WHEN region > 0 THEN CAST(region AS VARCHAR) END AS grp, 'cust-' || lpad(CAST(id AS VARCHAR), 9, '0') AS sid,
       CASE WHEN id % 3 = 0 THEN 0.0 WHEN id % 50 = 1 THEN NULL ELSE floor(acctbal / 500) END AS score FROM ({PANEL_CUSTOMER})"""
ORACLE["rank_null_group"] = f"""
SELECT grp, sid, row_number() OVER (PARTITION BY grp ORDER BY score DESC NULLS LAST, sid) AS pos FROM ({RANKED})"""
ORACLE["quantiles_null_group"] = f"""
WITH g AS (SELECT grp, quantile_cont(score, [0.1, 0.25, 0.5, 0.75, 0.9]) AS qs FROM ({RANKED}) WHERE score IS NOT NULL GROUP BY grp)
SELECT grp, CAST([0.1, 0.25, 0.5, 0.75, 0.9][i] AS DOUBLE) AS p, qs[i] AS q FROM g, range(1, 6) r(i)"""

ORACLE["smd_offset"] = with_customer("""
, w AS (SELECT t, CAST(before_cnt AS DOUBLE) AS x, CASE WHEN t = 1 THEN 1 - e ELSE e END AS w FROM nu),
m AS (SELECT t, sum(w * x) / (sum(w) + 1e-12) AS m, sum(w) AS sw FROM w GROUP BY t),
v AS (SELECT w.t, max(m.m) AS m, sum(w.w * (x - m.m) * (x - m.m)) / (max(m.sw) + 1e-12) AS v FROM w JOIN m ON w.t = m.t GROUP BY w.t),
s AS (SELECT (a.m - b.m) / (sqrt((a.v + b.v) / 2 + 1e-12) + 1e-12) AS smd FROM v a, v b WHERE a.t = 1 AND b.t = 0)
SELECT unnest(['at', 'before_cnt']) AS feature, round(smd, 6) + 0.0 AS smd FROM s""")
ORACLE["cuped_offset"] = with_customer("""
, tr AS (SELECT f.fold, regr_slope(q.y, q.before_amt) AS theta, avg(q.before_amt) AS xm
         FROM (SELECT DISTINCT fold FROM p) f JOIN p q ON q.fold <> f.fold GROUP BY f.fold),
cu AS (SELECT p.t, p.y, p.y - coalesce(tr.theta, 0.0) * (p.before_amt - tr.xm) AS yc FROM p JOIN tr USING (fold))
SELECT count(*) AS n,
       round(avg(CASE WHEN t = 1 THEN yc END) - avg(CASE WHEN t = 0 THEN yc END), 2) + 0.0 AS diff_cuped,
       round(1 - var_samp(yc) / var_samp(y), 5) + 0.0 AS var_reduction FROM cu""")

# ------------------------------------------------------------ fitted features, cleaning steps, small scores
ORACLE["feature_transform"] = TE_CTES + """,
tm AS (SELECT col, level, avg(te) AS te FROM te WHERE te IS NOT NULL GROUP BY col, level),
n AS (SELECT count(*) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS t1,
             count(CASE WHEN quality = 0 THEN 1 END) AS t0 FROM d),
c AS (SELECT col, level, count(*) AS c, count(CASE WHEN quality = 1 THEN 1 END) AS n1,
             count(CASE WHEN quality = 0 THEN 1 END) AS n0 FROM lv GROUP BY col, level),
w AS (SELECT col, level, c, CASE WHEN n1 > 0 AND n0 > 0 THEN ln((n1 / t1) / (n0 / t0)) END AS woe FROM c CROSS JOIN n),
g AS (SELECT d.lang, avg(CAST(x.n_chars AS DOUBLE)) AS m, CAST(count(x.n_chars) AS DOUBLE) AS k
      FROM d JOIN documents x ON x.doc_id = d.id GROUP BY d.lang),
a AS (SELECT doc_id AS id, n_chars, coalesce(CAST(lang AS VARCHAR), '__NA__') AS lang,
             coalesce(CAST(source AS VARCHAR), '__NA__') AS source FROM documents)
SELECT a.id, round(coalesce(tl.te, gm.gm), 6) + 0.0 AS lang__te, round(coalesce(ts.te, gm.gm), 6) + 0.0 AS source__te,
       CAST(coalesce(wl.c, 0) AS DOUBLE) AS lang__count, CAST(coalesce(ws.c, 0) AS DOUBLE) AS source__count,
       round(coalesce(wl.c, 0) / n.n, 6) + 0.0 AS lang__freq, round(coalesce(ws.c, 0) / n.n, 6) + 0.0 AS source__freq,
       round(wl.woe, 6) + 0.0 AS lang__woe, round(ws.woe, 6) + 0.0 AS source__woe,
       round(g.m, 6) + 0.0 AS grp_lang__n_chars__mean, g.k AS grp_lang__n_chars__count,
       round(CASE WHEN a.n_chars IS NOT NULL THEN ln(1 + greatest(CAST(a.n_chars AS DOUBLE), 0.0)) END, 6) + 0.0
         AS n_chars__log1p
FROM a CROSS JOIN gm CROSS JOIN n
LEFT JOIN tm tl ON tl.col = 'lang' AND tl.level = a.lang LEFT JOIN tm ts ON ts.col = 'source' AND ts.level = a.source
LEFT JOIN w wl ON wl.col = 'lang' AND wl.level = a.lang LEFT JOIN w ws ON ws.col = 'source' AND ws.level = a.source
LEFT JOIN g ON g.lang = a.lang"""

ORACLE["outcome_change"] = f"SELECT id, round(y - before_amt, 2) + 0.0 AS y_change FROM ({PANEL_CUSTOMER})"
ORACLE["capped_weights"] = with_customer(
    "SELECT id, round(least(CASE WHEN t = 1 THEN 1 / e ELSE 1 / (1 - e) END, 1.5), 6) + 0.0 AS weight FROM nu")
ORACLE["finite_rows"] = f"""
SELECT id, before_amt / before_cnt AS per_order FROM ({PANEL_CUSTOMER})
WHERE before_cnt > 0 AND acctbal > 0"""
ORACLE["repaired_predictions"] = with_customer("""
SELECT a.id,
       round((SELECT avg(b.y) FROM nu b WHERE b.t = 1 AND b.fold <> a.fold), 4) + 0.0 AS mu1,
       round((SELECT avg(b.y) FROM nu b WHERE b.t = 0 AND b.fold <> a.fold), 4) + 0.0 AS mu0
FROM nu a WHERE a.acctbal < 0""")
ORACLE["fused_scores"] = with_tau("SELECT id, round(0.7 * tau + 0.3 * psi, 4) + 0.0 AS score FROM ht")
ORACLE["validity_gate"] = with_tau("""
SELECT seg, count(CASE WHEN psi IS NOT NULL AND tau IS NOT NULL THEN 1 END) AS n_valid,
       count(CASE WHEN psi IS NOT NULL AND tau IS NOT NULL THEN 1 END) >= 30 AS valid,
       CASE WHEN count(CASE WHEN psi IS NOT NULL AND tau IS NOT NULL THEN 1 END) < 30
            THEN 'too few valid out-of-fold points' END AS note
FROM ht GROUP BY seg""")
ORACLE["class_weights"] = f"""
WITH n AS (SELECT CAST(sum(t) AS DOUBLE) AS a, CAST(sum(1 - t) AS DOUBLE) AS b FROM ({PANEL_CUSTOMER}))
SELECT 'balanced' AS scheme, round((a + b) / (2 * a), 6) + 0.0 AS treated, round((a + b) / (2 * b), 6) + 0.0 AS control FROM n
UNION ALL SELECT 'sqrt', round(sqrt(greatest(a, b) / a), 6) + 0.0, round(sqrt(greatest(a, b) / b), 6) + 0.0 FROM n"""

# ------------------------------------------------------------ NULL cells and NULL activities
NULL_CELL = f"(CASE WHEN region > 0 THEN {CUSTOMER_CELL} END)"
ORACLE["ate_null_cell"] = f"WITH {strata_ctes(PANEL_CUSTOMER, NULL_CELL)}\n{effect_select('nu', 'ATE')}"
ORACLE["batch_null_activity"] = "\nUNION ALL\n".join(
    f"SELECT * FROM ({campaign_sql(f'SELECT * FROM ({PANEL_CUSTOMER}) WHERE {cond}', s)})"
    for s, cond in [(None, "region = 0"), *[(s, f"region > 0 AND seg = '{s}'") for s in SEG_LEVELS]])

# ------------------------------------------------------------ placebo of linear learners
def placebo_linear_sql(runs: int, seed: int = SEED) -> str:
    """Regressions of one covariate per run, fold and arm over the rows of the other folds."""
    parts = []
    for y in ("y", "y_nc"):
        parts.append(f"""
SELECT CAST(run AS INTEGER) AS run, '{y}' AS outcome, count(*) AS n, round(avg(psi), 4) + 0.0 AS ate,
       round(avg(t * (y - mu0) - (1 - t) * (e / (1 - e)) * (y - mu0)) / (avg(t) + 1e-12), 4) + 0.0 AS att,
       round(sum(4.0 * e * (1 - e) * psi) / (sum(4.0 * e * (1 - e)) + 1e-12), 4) + 0.0 AS ato
FROM (SELECT *, t * (y - mu1) / e - (1 - t) * (y - mu0) / (1 - e) + (mu1 - mu0) AS psi
      FROM (SELECT q.run, q.t, q.{y} AS y, c.b1_{y} + c.s1_{y} * q.x AS mu1, c.b0_{y} + c.s0_{y} * q.x AS mu0,
                   greatest(least(greatest(least(c.be + c.se * q.x, {1 - TRIM}), {TRIM}), {PS_HI}), {PS_LO}) AS e
            FROM pr q JOIN co c ON c.run = q.run AND c.fold = q.fold))
GROUP BY run""")
    fits = ", ".join(f"""regr_intercept(q.{y}, q.x) FILTER (q.t = {a}) AS b{a}_{y}, regr_slope(q.{y}, q.x) FILTER (q.t = {a}) AS s{a}_{y}"""
                     for y in ("y", "y_nc") for a in (1, 0))
    return f"""
WITH p AS ({folded(PANEL_CUSTOMER, CUSTOMER_CELL, seed)}),
n1t AS (SELECT count(CASE WHEN t = 1 THEN 1 END) AS n1 FROM p),
rc0 AS (SELECT run, {coef_sql(seed)} FROM range(0, {runs}) r(run)),
rr AS (SELECT q.id, q.fold, q.y, q.y_nc, q.before_amt AS x, c.run,
              ((c.a1 * (q.h0 & 1073741823) + c.b1 * ((q.h0 >> 30) & 1073741823) + c.c1) % 2147483647) * 2147483648
              + (c.a2 * (q.h0 & 1073741823) + c.b2 * ((q.h0 >> 30) & 1073741823) + c.c2) % 2147483647 AS h
       FROM (SELECT *, {md5_int('id', f"'perm{seed}'")} AS h0 FROM p) q, rc0 c),
pr AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY run ORDER BY h, id) <= (SELECT n1 FROM n1t) THEN 1 ELSE 0 END AS t FROM rr),
co AS (SELECT f.run, f.fold, regr_intercept(q.t, q.x) AS be, regr_slope(q.t, q.x) AS se, {fits}
       FROM (SELECT DISTINCT run, fold FROM pr) f JOIN pr q ON q.run = f.run AND q.fold <> f.fold GROUP BY f.run, f.fold)
""" + "\nUNION ALL\n".join(parts)


ORACLE["placebo_linear"] = placebo_linear_sql(300)

# ------------------------------------------------------------ trees grown together, degenerate arms
TREE_CUTS = {"before_cnt": (0, 1, 2, 3, 4, 6, 8), "before_amt": tuple(range(0, 1_000_001, 100_000)),
             "acctbal": tuple(range(-500, 10_000, 500)), "region": (0, 1, 2, 3)}


def tree_sql(min_leaf: int = 20) -> str:
    """Best split of the root, then of its children, by reduction of squares over given cut points."""
    bins = "\nUNION ALL\n".join(
        f"SELECT id, model, yc, {i} AS f, 1 + " + " + ".join(f"CAST({c} > {v} AS INTEGER)" for v in cuts) + " AS b FROM q"
        for i, (c, cuts) in enumerate(TREE_CUTS.items()))

    def best(src: str) -> str:
        return f"""
SELECT model, node, f, b FROM (
  SELECT *, row_number() OVER (PARTITION BY model, node ORDER BY gain DESC, f, b) AS k FROM (
    SELECT *, ls * ls / lw + (s - ls) * (s - ls) / (n - lw) - s * s / n AS gain FROM (
      SELECT model, node, f, b,
             CAST(sum(c) OVER w AS DOUBLE) AS lw, CAST(sum(sy) OVER w AS DOUBLE) AS ls,
             CAST(sum(c) OVER (PARTITION BY model, node, f) AS DOUBLE) AS n,
             CAST(sum(sy) OVER (PARTITION BY model, node, f) AS DOUBLE) AS s
      FROM (SELECT model, node, f, b, count(*) AS c, sum(yc) AS sy FROM {src} GROUP BY ALL)
      WINDOW w AS (PARTITION BY model, node, f ORDER BY b))
    WHERE lw >= {min_leaf} AND n - lw >= {min_leaf})
  WHERE gain > 1e-12 * greatest(1.0, abs(s)))
WHERE k = 1"""

    def descend(src: str, split: str) -> str:
        return f"""
SELECT l.id, l.model, l.yc, l.f, l.b, 2 * l.node + 1 + CAST(x.b > s.b AS INTEGER) AS node
FROM {src} l JOIN {split} s ON s.model = l.model AND s.node = l.node JOIN {src} x ON x.id = l.id AND x.f = s.f"""

    return f"""
WITH q AS (SELECT *, 'arm' || t AS model, {cents('y')} AS yc FROM ({PANEL_CUSTOMER})),
l0 AS (SELECT *, 0 AS node FROM ({bins})),
s0 AS ({best('l0')}),
l1 AS ({descend('l0', 's0')}),
s1 AS ({best('l1')}),
l2 AS ({descend('l1', 's1')}),
every AS (SELECT * FROM (SELECT id, model, yc, f, b, node FROM l0 UNION ALL BY NAME SELECT * FROM l1 UNION ALL BY NAME SELECT * FROM l2)
          WHERE f = 0),
sp AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1)
SELECT e.model, CAST(e.node AS INTEGER) AS node, CAST(coalesce(max(sp.f), -1) AS INTEGER) AS feature,
       CAST(coalesce(max(sp.b), -1) AS INTEGER) AS bin, CAST(count(*) AS INTEGER) AS n, round(sum(yc) / count(*), 2) + 0.0 AS mean
FROM every e LEFT JOIN sp ON sp.model = e.model AND sp.node = e.node GROUP BY e.model, e.node"""


ORACLE["tree_depth2"] = tree_sql()

UNEVEN = f"""SELECT * REPLACE (CASE WHEN seg = 'BUILDING' AND t = 1 THEN 7.0 WHEN seg = 'FURNITURE' AND t = 1 AND id % 97 > 0 THEN 0.0
                                ELSE y END AS y)
FROM (SELECT * REPLACE (CASE WHEN seg = 'HOUSEHOLD' AND id % 40 <> 0 THEN 0 WHEN seg = 'MACHINERY' THEN 0 ELSE t END AS t)
      FROM ({PANEL_CUSTOMER}))"""
ARM_STATUS = f"""
u AS ({folded(UNEVEN, CUSTOMER_CELL)}),
st AS (
  SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN n < 10 THEN 'pooled'
                 WHEN n < 30 OR spread < 1e-8 OR zero_share >= 0.98 THEN 'constant' ELSE 'model' END AS route
  FROM (SELECT g.seg, g.fold, a.arm, count(q.y) FILTER (q.t = a.arm) AS n, avg(q.y) FILTER (q.t = a.arm) AS mean,
               stddev_pop(CAST({cents('q.y')} AS DOUBLE)) FILTER (q.t = a.arm) / 100 AS spread,
               avg(CASE WHEN q.y = 0 THEN 1.0 ELSE 0.0 END) FILTER (q.t = a.arm) AS zero_share, avg(q.y) AS pooled_mean
        FROM (SELECT DISTINCT seg, fold FROM u) g CROSS JOIN (VALUES (0), (1)) a(arm)
        LEFT JOIN u q ON q.seg = g.seg AND q.fold <> g.fold GROUP BY g.seg, g.fold, a.arm))"""
ORACLE["arm_fallbacks"] = f"""WITH {ARM_STATUS}
SELECT seg, fold, arm, n, round(mean, 4) + 0.0 AS mean, round(spread, 4) + 0.0 AS spread,
       round(zero_share, 6) + 0.0 AS zero_share, round(pooled_mean, 4) + 0.0 AS pooled_mean, route FROM st"""
ORACLE["ate_arm_fallbacks"] = "\nUNION ALL\n".join(f"""
SELECT * FROM (WITH {ARM_STATUS}, {strata_ctes(f"SELECT * FROM ({UNEVEN}) WHERE seg = '{s}'", CUSTOMER_CELL)},
ro AS (SELECT nu.* EXCLUDE (mu1, mu0, psi), {', '.join(
    f"CASE r{a}.route WHEN 'model' THEN nu.mu{a} WHEN 'constant' THEN r{a}.mean WHEN 'pooled' THEN r{a}.pooled_mean ELSE 0.0 END AS mu{a}"
    for a in (1, 0))}
       FROM nu {' '.join(f"JOIN st r{a} ON r{a}.seg = '{s}' AND r{a}.fold = nu.fold AND r{a}.arm = {a}" for a in (1, 0))}),
ps AS (SELECT t * (y - mu1) / e - (1 - t) * (y - mu0) / (1 - e) + (mu1 - mu0) AS psi FROM ro)
SELECT '{s}' AS seg, count(*) AS n, round(avg(psi), 4) + 0.0 AS est, round(stddev_samp(psi) / sqrt(count(*)), 4) + 0.0 AS se FROM ps)"""
    for s in SEG_LEVELS)

# ------------------------------------------------------------ composite score of given students
def _area_by_region(score: str) -> str:
    return f"""(SELECT region, count(*) AS n, (sum((n - rk + 1) * (psi - m)) - (max(CASE WHEN rk = 1 THEN psi - m END) + sum(psi - m)) / 2) / max(n) AS area
  FROM (SELECT region, psi, avg(psi) OVER (PARTITION BY region) AS m, count(*) OVER (PARTITION BY region) AS n,
               row_number() OVER (PARTITION BY region ORDER BY {score} DESC NULLS LAST, id) AS rk FROM st WHERE psi IS NOT NULL) GROUP BY region)"""


def _policy_by_region(score: str, name: str) -> str:
    tops = ", ".join(f"sum(CASE WHEN rk <= greatest(1, floor(n * {k})) THEN psi END) AS policy_{name}_{round(100 * k)}" for k in (0.1, 0.2, 0.3))
    return f"""(SELECT region, {tops} FROM (SELECT region, psi, count(*) OVER (PARTITION BY region) AS n,
               row_number() OVER (PARTITION BY region ORDER BY {score} DESC NULLS LAST, id) AS rk FROM st WHERE psi IS NOT NULL) GROUP BY region)"""


_RATIO = " + ".join(f"CASE WHEN abs(policy_teacher_{k}) < 1e-12 THEN 0.0 ELSE least(greatest(policy_student_{k} / policy_teacher_{k}, 0.0), 1.2) END"
                    for k in (10, 20, 30))
ORACLE["distill_scores"] = with_tau(f"""
, st AS (SELECT *, round(before_amt / 50000) + before_cnt % 3 AS student FROM ht),
rk AS (SELECT region, tau, student,
              rank() OVER (PARTITION BY region ORDER BY tau) + (count(*) OVER (PARTITION BY region, tau) - 1) / 2.0 AS ra,
              rank() OVER (PARTITION BY region ORDER BY student) + (count(*) OVER (PARTITION BY region, student) - 1) / 2.0 AS rb
       FROM st WHERE tau IS NOT NULL AND student IS NOT NULL),
sp AS (SELECT region, coalesce(corr(ra, rb), 0.0) AS spearman FROM rk GROUP BY region),
j AS (SELECT t.region, t.n, CASE WHEN abs(o.area) < 1e-12 THEN 0.0 ELSE least(greatest(t.area / o.area, 0.0), 1.0) END AS nauuc_teacher,
             CASE WHEN abs(o.area) < 1e-12 THEN 0.0 ELSE least(greatest(s.area / o.area, 0.0), 1.0) END AS nauuc_student,
             sp.spearman, pt.* EXCLUDE (region), ps.* EXCLUDE (region)
      FROM {_area_by_region('tau')} t JOIN {_area_by_region('student')} s USING (region) JOIN {_area_by_region('psi')} o USING (region) JOIN sp USING (region)
      JOIN {_policy_by_region('tau', 'teacher')} pt USING (region) JOIN {_policy_by_region('student', 'student')} ps USING (region)),
x AS (SELECT *, CASE WHEN nauuc_teacher <= 1e-12 THEN 0.0 ELSE nauuc_student / nauuc_teacher END AS nauuc_ratio, ({_RATIO}) / 3 AS policy_ratio FROM j)
SELECT region, n, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('nauuc_teacher', 'nauuc_student', 'spearman', 'nauuc_ratio', 'policy_ratio'))},
       round(0.6 * nauuc_ratio + 0.3 * greatest(0.0, spearman) + 0.1 * policy_ratio, 6) + 0.0 AS score,
       nauuc_ratio >= 0.7 AND spearman >= 0.6 AND policy_student_10 >= 0.85 * policy_teacher_10
         AND policy_student_20 >= 0.85 * policy_teacher_20 AND policy_student_30 >= 0.85 * policy_teacher_30 AS passed,
       {', '.join(f'round(policy_{w}_{k}, 0) + 0.0 AS policy_{w}_{k}' for w in ('teacher', 'student') for k in (10, 20, 30))}
FROM x""")

# ------------------------------------------------------------ mergeable statistics, file rejects, panel checks
ORACLE["late_arrivals"] = "\nUNION ALL\n".join(f"""
SELECT * FROM (WITH {strata_ctes(f"SELECT * FROM ({PANEL_CUSTOMER}) WHERE seg = '{s}'", CUSTOMER_CELL)}
SELECT '{s}' AS seg, '{e}' AS estimand, n, n_treated, n_control, est, se FROM ({effect_select('nu', e)}))"""
    for s in SEG_LEVELS for e in ("ATE", "ATT", "ATO"))
ORACLE["csv_rejects"] = f"""
WITH p AS (SELECT *, id % 19 = 0 OR id % 23 = 0 OR id % 29 = 0 AS broken FROM ({PANEL_CUSTOMER}))
SELECT 'rows' AS kind, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum, round(sum(y), 2) + 0.0 AS y_sum FROM p WHERE NOT broken
UNION ALL SELECT 'rejects', count(*), CAST(sum(id) AS BIGINT), NULL FROM p WHERE broken"""
ORACLE["panel_faults"] = f"""
WITH p AS (SELECT CASE WHEN id % 50 > 0 THEN id - id % 7 % 2 END AS id, CASE WHEN id % 31 = 0 THEN 2 WHEN id % 37 > 0 THEN t END AS t,
                  CASE WHEN id % 41 = 0 THEN CAST('nan' AS DOUBLE) WHEN id % 43 > 0 THEN y END AS y FROM ({PANEL_CUSTOMER}))
SELECT count(*) AS n, count(*) FILTER (t IS NULL) AS t_null, count(*) FILTER (t NOT IN (0, 1)) AS t_invalid, count(*) FILTER (y IS NULL) AS y_null,
       count(*) FILTER (isnan(y)) AS y_not_finite, count(*) FILTER (id IS NULL) AS id_null, count(id) - count(DISTINCT id) AS id_repeated FROM p"""

# ------------------------------------------------------------ saved features, symbolic search
ORACLE["feature_saved"] = ORACLE["feature_transform"]


def symbolic_sql() -> str:
    """All expressions one step from three columns, written out."""
    a, b, c = cols = ("acctbal", "before_amt", "before_cnt")
    x = {n: f"CAST({n} AS DOUBLE)" for n in cols}
    items = [(n, 1, x[n]) for n in cols]
    for n in cols:
        items += [(f"square({n})", 2, f"{x[n]} * {x[n]}"), (f"abs({n})", 2, f"abs({x[n]})"),
                  (f"sqrt({n})", 2, f"CASE WHEN {x[n]} >= 0 THEN sqrt({x[n]}) END"),
                  (f"log({n})", 2, f"CASE WHEN {x[n]} > 0 THEN ln({x[n]}) END")]
    for p, q in ((a, b), (a, c), (b, c)):
        items += [(f"({p} {op} {q})", 3, f"{x[p]} {op} {x[q]}") for op in "+*"]
        for l, r in ((p, q), (q, p)):
            items += [(f"({l} - {r})", 3, f"{x[l]} - {x[r]}"), (f"({l} / {r})", 3, f"{x[l]} / nullif({x[r]}, 0)")]
    one = "\nUNION ALL\n".join(f"SELECT '{t}' AS expression, {k} AS size, y, {e} AS x FROM p" for t, k, e in items)
    return f"""
WITH p AS ({PANEL_CUSTOMER}), v AS ({one}),
m AS (SELECT expression, max(size) AS size, count(x) AS n, count(*) AS al, covar_pop(x, y) AS xy,
             sqrt(var_pop(x)) * sqrt(var_pop(CASE WHEN x IS NOT NULL THEN y END)) AS sp FROM v GROUP BY expression),
c AS (SELECT *, CASE WHEN n >= 0.5 * al AND sp > 0 THEN greatest(-1.0, least(1.0, xy / sp)) END AS corr FROM m)
SELECT expression, CAST(size AS INTEGER) AS size, n, round(corr, 6) + 0.0 AS corr, round(abs(corr) - 0.001 * size, 6) + 0.0 AS score FROM c"""


ORACLE["symbolic_scores"] = symbolic_sql()

# ------------------------------------------------------------ campaign diagnosis
_CAMP = strata_ctes(PANEL_CUSTOMER, CUSTOMER_CELL, "y", "a_", CAMP_SEED, CAMP_K, CAMP_PS)
_TOPS = ", ".join(f"CASE WHEN bandnote IS NULL AND nv >= 30 THEN round(p{round(100 * k)}, 2) + 0.0 END AS policy_{round(100 * k)}" for k in (0.1, 0.2, 0.3))
ORACLE["campaign_diagnosis"] = f"""
WITH {_CAMP}{placebo_ctes("y", "a_", 5, CAMP_SEED, CAMP_PS)}{tau_ctes('a_', (0.2, 0.8), CAMP_K)}
, nu AS (SELECT * FROM a_nu),
lg AS (SELECT t, e, unnest(['before_cnt', 'before_amt', 'acctbal', 'region']) AS feature,
              unnest([CAST(before_cnt AS DOUBLE), before_amt, acctbal, CAST(region AS DOUBLE)]) AS x FROM nu),
wx AS (SELECT feature, t, x, least(CASE WHEN t = 1 THEN t / e ELSE (1 - t) / (1 - e) END, 10.0) AS w FROM lg WHERE x IS NOT NULL),
mm AS (SELECT feature, t, sum(w * x) / (sum(w) + 1e-12) AS m, sum(w) AS sw FROM wx GROUP BY feature, t),
vv AS (SELECT wx.feature, wx.t, max(mm.m) AS m, sum(wx.w * (x - mm.m) * (x - mm.m)) / (max(mm.sw) + 1e-12) AS v
       FROM wx JOIN mm ON wx.feature = mm.feature AND wx.t = mm.t GROUP BY wx.feature, wx.t),
sm AS (SELECT max(abs((a.m - b.m) / (sqrt((a.v + b.v) / 2 + 1e-12) + 1e-12))) AS smd_max
       FROM vv a JOIN vv b ON a.feature = b.feature AND a.t = 1 AND b.t = 0),
ov AS (SELECT sum(least(c1 / n1, c0 / n0)) AS ovl
       FROM (SELECT least(floor(e * 50), 49) AS bin, count(CASE WHEN t = 1 THEN 1 END) AS c1, count(CASE WHEN t = 0 THEN 1 END) AS c0 FROM nu GROUP BY 1) b,
            (SELECT count(CASE WHEN t = 1 THEN 1 END) AS n1, count(CASE WHEN t = 0 THEN 1 END) AS n0 FROM nu) s),
kv AS (SELECT e, count(CASE WHEN t = 1 THEN 1 END) AS c1, count(CASE WHEN t = 0 THEN 1 END) AS c0 FROM nu GROUP BY e),
kk AS (SELECT max(abs(cum1 / n1 - cum0 / n0)) AS ks FROM (
         SELECT sum(c1) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) AS cum1, sum(c0) OVER (ORDER BY e ROWS UNBOUNDED PRECEDING) AS cum0,
                sum(c1) OVER () AS n1, sum(c0) OVER () AS n0 FROM kv)),
pp AS (SELECT max(o.n) AS n, (count(CASE WHEN abs(r.ate) >= abs(o.est) THEN 1 END) + 1) / (count(*) + 1) AS placebo_p
       FROM a_re r, (SELECT count(*) AS n, avg(psi) AS est FROM nu) o),
bd AS (SELECT * FROM a_ht WHERE e BETWEEN 0.2 AND 0.8),
bn AS (SELECT count(*) AS nb, count(CASE WHEN t = 1 THEN 1 END) AS b1, count(CASE WHEN t = 0 THEN 1 END) AS b0 FROM bd),
nt AS (SELECT nb, CASE WHEN nb < 50 OR b1 = 0 OR b0 = 0 THEN 'band too small or one arm' END AS bandnote FROM bn),
ht AS (SELECT * FROM bd),
au AS (SELECT CASE WHEN abs(o.area) <= 1e-12 THEN NULL ELSE least(greatest(m.area / o.area, 0.0), 1.0) END AS nauuc
       FROM ({_area('tau', True)}) m, ({_area('psi', True)}) o),
po AS (SELECT count(*) AS nv, {', '.join(f"sum(CASE WHEN r <= greatest(1, floor(n * CAST({k} AS DOUBLE))) THEN psi END) AS p{round(100 * k)}" for k in (0.1, 0.2, 0.3))}
       FROM (SELECT psi, row_number() OVER (ORDER BY tau DESC NULLS LAST, id) AS r, count(*) OVER () AS n FROM bd WHERE psi IS NOT NULL)),
f AS (SELECT *, coalesce(ovl >= 0.5 AND ks <= 0.6, false) AS overlap_pass, coalesce(smd_max <= 0.3, false) AS balance_pass,
             coalesce(placebo_p >= 0.09, false) AS placebo_pass, true AS negctrl_pass FROM ov, kk, sm, pp, nt, au, po),
g AS (SELECT *, CAST(overlap_pass AS INT) + CAST(balance_pass AS INT) + CAST(placebo_pass AS INT) + 1 AS n_pass FROM f)
SELECT 'cust-1998' AS activity_id, n, round(ovl, 6) + 0.0 AS ovl, round(ks, 6) + 0.0 AS ks, round(smd_max, 6) + 0.0 AS smd_max,
       round(placebo_p, 6) + 0.0 AS placebo_p, round(nb / n, 6) + 0.0 AS band_coverage,
       CASE WHEN bandnote IS NULL AND nv >= 30 THEN round(nauuc, 6) + 0.0 END AS nauuc, {_TOPS},
       overlap_pass, balance_pass, placebo_pass, negctrl_pass, n_pass,
       CASE WHEN n_pass = 4 THEN 'credible' WHEN n_pass >= 2 THEN 'doubtful' ELSE 'fail' END AS verdict, nb AS n_band,
       coalesce(bandnote, CASE WHEN nv < 30 THEN 'too few valid out-of-fold points' END) AS note FROM g"""

ORACLE["campaign_record_flat"] = f"""
SELECT activity_id AS activity_uuid, '2026-01-01T00:00:00Z' AS created_at, 't' AS t_col, 'y' AS y_col, CAST(n_samples AS INTEGER) AS n_samples,
       CAST(n_treated AS INTEGER) AS n_treated, CAST(n_control AS INTEGER) AS n_control, ate_point, ate_ci_lo, ate_ci_hi, att_point, att_ci_lo, att_ci_hi,
       {', '.join(f'{x}_p{p}' for x in ('tau', 'tau_band') for p in (10, 25, 50, 75, 90))}, ate_se, ate_placebo_p, att_se, att_placebo_p,
       CAST(0.2 AS DOUBLE) AS att_band_lo, CAST(0.8 AS DOUBLE) AS hte_band_hi, CAST(treated_kept AS INTEGER) AS treated_kept,
       CAST(treated_total AS INTEGER) AS treated_total, treated_coverage
FROM ({ORACLE['campaign_result']})"""
