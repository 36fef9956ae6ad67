"""DuckDB oracle SQL for every catalogue query.

The SQL restates the definitions directly and, where the engine uses closed
forms, independently: first-year interest and lifetime expected loss are
summed month by month over a generated month table, the way the row loop
defines them. Literals are typed DOUBLE (DuckDB's decimal literals would do
exact decimal arithmetic); outputs use NumPy rounding, ``round_even(x*10^d)/10^d``.
"""

from __future__ import annotations

from dataclasses import replace

from ..params import Covenants, RunParams, Scenario
from ..sources.testdata import LOANS_SQL
from . import catalogue as cat

# --- Fixed values, stated here again and not taken from the engine, so that a
# --- wrong constant on either side shows as a difference ---------------------
SCORE_BANDS = ((760, 0.005), (720, 0.008), (680, 0.015), (640, 0.030), (600, 0.060))
SCORE_FLOOR_PD, SCORE_MISSING_PD = 0.100, 0.03
DTI_BANDS, DTI_ABOVE, DTI_MISSING = ((0.20, 1.0), (0.35, 1.2), (0.50, 1.6)), 2.2, 1.2
LTV_BANDS, LTV_ABOVE, LTV_MISSING = ((0.70, 1.0), (0.85, 1.2), (1.00, 1.5)), 2.0, 1.2
SECTOR_FACTORS = {
    "construction": 1.30, "retail": 1.25, "realestate": 1.20, "real estate": 1.20,
    "hospitality": 1.25, "manufacturing": 1.10, "healthcare": 1.10, "transport": 1.15,
}
SECTOR_DEFAULT = 1.0
PD_FLOOR, PD_CAP, PD_ST_FLOOR, PD_ST_CAP = 0.002, 0.35, 0.002, 0.60
HAIRCUTS = {
    "realestate": 0.30, "real estate": 0.30, "equipment": 0.45, "inventory": 0.60,
    "ar": 0.60, "accounts receivable": 0.60, "securities": 0.10,
}
HAIRCUT_DEFAULT, RECOVERY_COST = 0.50, 0.10
LGD_NO_COLLATERAL, LGD_FLOOR, LGD_CAP = 0.60, 0.05, 0.95
TIER_PD_FLOOR, TIER_MIN_COUNT, TIER_FALLBACK, TIER_MIN_GAP = 1e-5, 6, (0.02, 0.06), 0.003
TIER_PERCENTILES = (0.33, 0.66)
THRESHOLD_HIGH, THRESHOLD_MEDIUM = (0.06, 0.90, 1.20, 0.45), (0.02, 0.80, 1.50, 0.35)
# -----------------------------------------------------------------------------


def D(x) -> str:
    """A DOUBLE literal carrying the exact binary value of the Python float."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def SUM(expr: str) -> str:
    """The sum of each value's multiple of 2^-30, as whole numbers; 0 without values."""
    return f"(coalesce(sum(CAST(round_even(({expr}) * 1073741824e0, 0) AS HUGEINT)), 0)::DOUBLE / 1073741824e0)"


def RND(expr: str, d: int) -> str:
    if d == 0:
        return f"round_even({expr}, 0)"
    return f"(round_even(({expr}) * 1e{d}, 0) / 1e{d})"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def norm_dim(c: str) -> str:
    s = f"regexp_replace({strip(c)}, '\\s+', ' ', 'g')"
    return f"CASE WHEN {s} IS NULL OR lower({s}) IN ('', 'nan', 'none', 'null') THEN 'Unknown' ELSE {s} END"


def key(c: str) -> str:
    return f"lower({strip(f'coalesce({c}, {chr(39)}{chr(39)})')})"


def lookup(c: str, table: dict, default) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {D(v)}" for k, v in table.items())
    return f"(CASE {key(c)} {whens} ELSE {D(default)} END)"


def no_nan(expr: str) -> str:
    return f"(CASE WHEN NOT isnan({expr}) THEN {expr} END)"


def pay(P: str, R: str, n: str) -> str:
    r = f"({R} / 12e0)"
    g = f"pow(1e0 + {r}, {n})"
    return (f"(CASE WHEN {P} IS NULL OR {R} IS NULL OR {n} IS NULL OR {n} <= 0 THEN NULL "
            f"WHEN abs({r}) < 1e-12 THEN {P} / {n} "
            f"ELSE {no_nan(f'({P} * {g}) / (({g} - 1e0) / {r})')} END)")


def bal12(P: str, R: str, n: str, A: str) -> str:
    r = f"({R} / 12e0)"
    g = f"pow(1e0 + {r}, 12e0)"
    return (f"(CASE WHEN {P} IS NULL OR {R} IS NULL OR {n} IS NULL THEN NULL "
            f"WHEN {n} <= 12 THEN 0e0 "
            f"WHEN abs({r}) < 1e-12 THEN greatest({P} - ({P} / {n}) * 12e0, 0e0) "
            f"ELSE {P} * {g} - {A} * ({g} - 1e0) / {r} END)")


def pd_card(cs: str, dti: str, ltv: str, sector: str) -> str:
    base = f"CASE WHEN {cs} IS NULL THEN {D(SCORE_MISSING_PD)} " + " ".join(
        f"WHEN {cs} >= {D(b)} THEN {D(v)}" for b, v in SCORE_BANDS) + f" ELSE {D(SCORE_FLOOR_PD)} END"
    dti_f = f"CASE WHEN {dti} IS NULL THEN {D(DTI_MISSING)} " + " ".join(
        f"WHEN {dti} <= {D(b)} THEN {D(v)}" for b, v in DTI_BANDS) + f" ELSE {D(DTI_ABOVE)} END"
    ltv_f = f"CASE WHEN {ltv} IS NULL THEN {D(LTV_MISSING)} " + " ".join(
        f"WHEN {ltv} <= {D(b)} THEN {D(v)}" for b, v in LTV_BANDS) + f" ELSE {D(LTV_ABOVE)} END"
    prod = f"(({base}) * ({dti_f}) * ({ltv_f}) * {lookup(sector, SECTOR_FACTORS, SECTOR_DEFAULT)})"
    return f"least(greatest({prod}, {D(PD_FLOOR)}), {D(PD_CAP)})"


def lgd(P: str, C: str, ctype: str) -> str:
    h = lookup(ctype, HAIRCUTS, HAIRCUT_DEFAULT)
    rec = f"least(greatest({C}, 0e0) * (1e0 - {h}) / {P}, 1e0) * (1e0 - {D(RECOVERY_COST)})"
    return (f"(CASE WHEN {P} IS NULL OR {P} <= 0 OR {C} IS NULL OR {C} <= 0 THEN {D(LGD_NO_COLLATERAL)} "
            f"ELSE least(greatest(1e0 - {rec}, {D(LGD_FLOOR)}), {D(LGD_CAP)}) END)")


def ead(P: str, B: str) -> str:
    return f"(CASE WHEN {P} IS NULL THEN NULL WHEN {B} IS NULL THEN {P} ELSE 0.5e0 * ({P} + greatest(0e0, {B})) END)"


def tier_x(pd: str) -> str:
    return f"(round_even(greatest({pd}, {D(TIER_PD_FLOOR)}) * 1e12, 0) / 1e12)"


def tier(pd: str) -> str:
    x = tier_x(pd)
    return (f"(CASE WHEN {x} <= q_low THEN 'Low' WHEN {x} <= q_high THEN 'Medium' "
            f"WHEN {x} > q_high THEN 'High' ELSE 'Medium' END)")


def interest_y1_sum(src: str, R: str, A: str, keys: str) -> str:
    """Sum of r * opening balance over the first min(12, n) months, balance by recursion's closed form."""
    r = f"({R} / 12e0)"
    g = f"pow(1e0 + {r}, CAST(j AS DOUBLE))"
    bal = f"greatest(LoanAmount * {g} - {A} * ({g} - 1e0) / {r}, 0e0)"
    return (f"SELECT {keys}, sum({bal} * {r}) AS iy FROM {src} JOIN months ON j < least(TermMonths, 12) "
            f"WHERE LoanAmount > 0 AND {R} IS NOT NULL AND {A} IS NOT NULL AND abs({r}) >= 1e-12 GROUP BY {keys}")


def interest_y1(R: str, iy: str) -> str:
    return (f"(CASE WHEN LoanAmount IS NULL OR {R} IS NULL OR TermMonths IS NULL THEN NULL "
            f"WHEN abs({R} / 12e0) < 1e-12 THEN 0e0 WHEN LoanAmount < 0 THEN NULL "
            f"WHEN LoanAmount = 0 THEN 0e0 ELSE {iy} END)")


def hazard(pd: str) -> str:
    return (f"(CASE WHEN {pd} IS NULL OR {pd} <= 0 THEN 0e0 "
            f"ELSE 1e0 - pow(1e0 - least(greatest({pd}, 1e-9), {D(0.99)}), 1e0 / 12e0) END)")


def schedule_rows(src: str, R: str, A: str, pd: str, lgd_col: str, d: float) -> str:
    """One row per (loan, scenario, month) while the balance lasts, with the
    month's discounted loss: S_{m-1} * p * LGD * B_{m-1} / (1+d)^m."""
    g = "pow(1e0 + rm, CAST(j AS DOUBLE))"
    closed = f"(CASE WHEN abs(rm) < 1e-12 THEN prin - (prin / nm) * CAST(j AS DOUBLE) ELSE prin * {g} - pay * ({g} - 1e0) / rm END)"
    return f"""
      SELECT LoanID, Scenario, j + 1 AS month, ob,
             CASE WHEN abs(rm) < 1e-12 THEN 0e0 ELSE ob * rm END AS interest,
             pay - CASE WHEN abs(rm) < 1e-12 THEN 0e0 ELSE ob * rm END AS principal,
             pow(1e0 - haz, CAST(j AS DOUBLE)) AS survival, pow(1e0 - haz, CAST(j AS DOUBLE)) * haz AS default_mass,
             pow(1e0 - haz, CAST(j AS DOUBLE)) * haz * lgdc * ob AS loss,
             pow(1e0 - haz, CAST(j AS DOUBLE)) * haz * lgdc * ob / pow(1e0 + {D(d)}, CAST(j + 1 AS DOUBLE)) AS loss_pv
      FROM (
        SELECT LoanID, Scenario, j, haz, lgdc, rm, pay,
               CASE WHEN j = 0 THEN prin ELSE greatest({closed}, 0e0) END AS ob,
               (j = 0 OR {closed} > 1e-8) AS live
        FROM (
          SELECT LoanID, Scenario, LoanAmount AS prin, ({R} / 12e0) AS rm, TermMonths AS nm, {A} AS pay,
                 {hazard(pd)} AS haz, least(greatest({lgd_col}, 0e0), 1e0) AS lgdc
          FROM {src}
          WHERE LoanAmount IS NOT NULL AND {R} IS NOT NULL AND TermMonths > 0 AND {A} IS NOT NULL
            AND {pd} IS NOT NULL AND {lgd_col} IS NOT NULL
        ) x JOIN months ON j < nm
      ) y WHERE live"""


def _scenario_values(params: RunParams) -> str:
    rows = ", ".join(
        f"('{s.name}', {i}, {D(s.rate_bps)}, {D(s.unemp_pp)}, {D(s.coll_drop)}, {D(s.unemp_mult)})"
        for i, s in enumerate(params.scenarios)
    )
    return f"SELECT * FROM (VALUES {rows}) AS t(Scenario, scenario_order, rate_bps, unemp_pp, coll_drop, unemp_mult)"


def _badge(cov: Covenants) -> str:
    def any_of(d, i, l, t):
        return (f"coalesce(DSCR_st < {D(d)}, false) OR coalesce(ICR_st < {D(i)}, false) "
                f"OR coalesce(LTV_st > {D(l)}, false) OR coalesce(DTI_st > {D(t)}, false)")
    return (f"CASE WHEN {any_of(cov.dscr_min, cov.icr_min, cov.ltv_max, cov.dti_max)} THEN 'Red' "
            f"WHEN {any_of(cov.dscr_amber, cov.icr_amber, cov.ltv_amber, cov.dti_amber)} THEN 'Amber' ELSE 'Green' END")


def ctes(params: RunParams = RunParams()) -> str:
    cov, pr = params.covenants, params.pricing
    d = params.discount_rate_pct / 100.0 / 12.0
    lo_p, hi_p = TIER_PERCENTILES
    return f"""
WITH loans AS ({LOANS_SQL}),
clean AS (
  SELECT LoanID, Borrower, {norm_dim('Sector')} AS Sector, {norm_dim('Geography')} AS Geography,
         LoanAmount,
         CASE WHEN InterestRate > 1 THEN InterestRate / 1e2 ELSE InterestRate END AS InterestRate_clean,
         CASE WHEN TermMonths > 0 THEN TermMonths END AS TermMonths,
         CreditScore, MonthlyIncome, EBITDA, CollateralValue, CurrentMarketValue, CollateralType,
         CASE WHEN CurrentMarketValue > 0 THEN greatest(CurrentMarketValue, 1e-9)
              WHEN CollateralValue > 0 THEN greatest(CollateralValue, 1e-9) END AS CollateralBase
  FROM loans),
cf AS (SELECT *, {pay('LoanAmount', 'InterestRate_clean', 'TermMonths')} AS MonthlyPayment FROM clean),
cf2 AS (SELECT *, MonthlyPayment * 12e0 AS AnnualDebtService,
               {bal12('LoanAmount', 'InterestRate_clean', 'TermMonths', 'MonthlyPayment')} AS Balance_12m FROM cf),
months AS (SELECT CAST(range AS INTEGER) AS j FROM range(0, (
  SELECT coalesce(max(TermMonths), 0) FROM cf WHERE MonthlyPayment IS NOT NULL))),
iy AS ({interest_y1_sum('cf2', 'InterestRate_clean', 'MonthlyPayment', 'LoanID')}),
b1 AS (SELECT cf2.*, {interest_y1('InterestRate_clean', 'iy.iy')} AS Interest_Y1 FROM cf2 LEFT JOIN iy USING (LoanID)),
b2 AS (SELECT *, LoanAmount / nullif(CollateralBase, 0) AS LTV,
              MonthlyPayment / nullif(MonthlyIncome, 0) AS DTI,
              (MonthlyIncome * 12e0) / nullif(AnnualDebtService, 0) AS DSCR,
              EBITDA / nullif(Interest_Y1, 0) AS ICR FROM b1),
b3 AS (SELECT *, {pd_card('CreditScore', 'DTI', 'LTV', 'Sector')} AS PD_12m,
              {lgd('LoanAmount', 'CollateralBase', 'CollateralType')} AS LGD,
              {ead('LoanAmount', 'Balance_12m')} AS EAD_12m FROM b2),
base AS (SELECT *, PD_12m * LGD * EAD_12m AS EL_12m FROM b3),
q AS (SELECT count(x) AS n_pd, quantile_cont(x, {lo_p}) AS lo, quantile_cont(x, {hi_p}) AS hi
      FROM (SELECT {tier_x('PD_12m')} AS x FROM base) t),
q2 AS (SELECT n_pd, CASE WHEN n_pd < {TIER_MIN_COUNT} THEN {D(TIER_FALLBACK[0])} ELSE lo END AS lo,
              CASE WHEN n_pd < {TIER_MIN_COUNT} THEN {D(TIER_FALLBACK[1])} ELSE hi END AS hi FROM q),
cuts AS (SELECT n_pd,
                CASE WHEN hi - lo < {D(TIER_MIN_GAP)} THEN (lo + hi) / 2e0 - {D(TIER_MIN_GAP / 2)} ELSE lo END AS q_low,
                CASE WHEN hi - lo < {D(TIER_MIN_GAP)} THEN (lo + hi) / 2e0 + {D(TIER_MIN_GAP / 2)} ELSE hi END AS q_high
         FROM q2),
tiered AS (SELECT base.*, q_low, q_high, {tier('PD_12m')} AS RiskTier FROM base CROSS JOIN cuts),
scen AS ({_scenario_values(params)}),
s1 AS (SELECT t.*, s.Scenario, s.rate_bps, s.coll_drop, s.unemp_mult,
              CASE WHEN InterestRate_clean IS NULL THEN NULL
                   ELSE greatest(InterestRate_clean + s.rate_bps / 1e4, 0e0) END AS InterestRate_st,
              CASE WHEN CollateralBase IS NULL THEN NULL
                   ELSE greatest(CollateralBase * (1e0 - s.coll_drop / 1e2), 1e-9) END AS CollateralBase_st
       FROM tiered t CROSS JOIN scen s),
s2 AS (SELECT *, {pay('LoanAmount', 'InterestRate_st', 'TermMonths')} AS MonthlyPayment_st FROM s1),
s3 AS (SELECT *, MonthlyPayment_st * 12e0 AS AnnualDebtService_st,
              {bal12('LoanAmount', 'InterestRate_st', 'TermMonths', 'MonthlyPayment_st')} AS Balance_12m_st FROM s2),
iy_st AS ({interest_y1_sum('s3', 'InterestRate_st', 'MonthlyPayment_st', 'LoanID, Scenario')}),
s4 AS (SELECT s3.*, {interest_y1('InterestRate_st', 'iy_st.iy')} AS Interest_Y1_st
       FROM s3 LEFT JOIN iy_st USING (LoanID, Scenario)),
s5 AS (SELECT *, LoanAmount / CollateralBase_st AS LTV_st,
              MonthlyPayment_st / nullif(MonthlyIncome, 0) AS DTI_st,
              (MonthlyIncome * 12e0) / nullif(AnnualDebtService_st, 0) AS DSCR_st,
              EBITDA / nullif(Interest_Y1_st, 0) AS ICR_st FROM s4),
s6 AS (SELECT *, {pd_card('CreditScore', 'DTI_st', 'LTV_st', 'Sector')} AS PD_12m_st_preU FROM s5),
s7 AS (SELECT *, least(greatest(PD_12m_st_preU * unemp_mult, {D(PD_ST_FLOOR)}), {D(PD_ST_CAP)}) AS PD_12m_st,
              {lgd('LoanAmount', 'CollateralBase_st', 'CollateralType')} AS LGD_st,
              {ead('LoanAmount', 'Balance_12m_st')} AS EAD_12m_st FROM s6),
stressed AS (SELECT *, PD_12m_st * LGD_st * EAD_12m_st AS EL_12m_st, {tier('PD_12m_st')} AS RiskTier_st FROM s7),
cov1 AS (SELECT *, DSCR_st - {D(cov.dscr_min)} AS HR_DSCR_st, ICR_st - {D(cov.icr_min)} AS HR_ICR_st,
                {D(cov.ltv_max)} - LTV_st AS HR_LTV_st, {D(cov.dti_max)} - DTI_st AS HR_DTI_st,
                {_badge(cov)} AS Badge_st FROM stressed),
cov2 AS (SELECT *, least(HR_DSCR_st, HR_ICR_st, HR_LTV_st, HR_DTI_st) AS WorstHeadroom_st FROM cov1),
covs AS (SELECT *, CASE WHEN HR_DSCR_st = WorstHeadroom_st THEN 'DSCR' WHEN HR_ICR_st = WorstHeadroom_st THEN 'ICR'
                        WHEN HR_LTV_st = WorstHeadroom_st THEN 'LTV' WHEN HR_DTI_st = WorstHeadroom_st THEN 'DTI' END AS Tightest
         FROM cov2),
sched_base AS ({schedule_rows('stressed', 'InterestRate_clean', 'MonthlyPayment', 'PD_12m', 'LGD', d)}),
sched_st AS ({schedule_rows('stressed', 'InterestRate_st', 'MonthlyPayment_st', 'PD_12m_st', 'LGD_st', d)}),
el_b AS (SELECT LoanID, Scenario, sum(loss_pv) AS el FROM sched_base GROUP BY LoanID, Scenario),
el_s AS (SELECT LoanID, Scenario, sum(loss_pv) AS el FROM sched_st GROUP BY LoanID, Scenario),
life AS (SELECT s.*, el_b.el AS EL_life_base, el_s.el AS EL_life_st
         FROM stressed s LEFT JOIN el_b USING (LoanID, Scenario) LEFT JOIN el_s USING (LoanID, Scenario)),
priced AS (SELECT *, CASE WHEN EAD_12m_st > 0 THEN EL_12m_st / EAD_12m_st END AS EL_rate_st FROM stressed),
priced2 AS (SELECT *, EL_rate_st + {D(pr.add_ons)} AS SuggestedSpread_pct FROM priced),
pricing AS (SELECT *, SuggestedSpread_pct * 1e4 AS SuggestedSpread_bps,
                   ({D(pr.funding_cost_pct / 100.0)} + SuggestedSpread_pct) * 1e2 AS SuggestedAllInRate_pct FROM priced2)
"""


def _kpi_select():
    def quad(prefix, ead_c, pd_c, el_c, tier_c):
        high = f"CASE WHEN {tier_c} = 'High' THEN {ead_c} END"
        return (f"{SUM(ead_c)} AS {prefix}total_ead, {SUM(f'{pd_c} * {ead_c}')} AS {prefix}pd_ead, "
                f"{SUM(el_c)} AS {prefix}total_el, {SUM(high)} AS {prefix}high_ead")

    def fin(prefix):
        return (f"{prefix}total_ead, CASE WHEN {prefix}total_ead > 0 THEN {prefix}pd_ead / {prefix}total_ead END AS {prefix}wavg_pd, "
                f"{prefix}total_el, CASE WHEN {prefix}total_ead > 0 THEN {prefix}high_ead / {prefix}total_ead * 1e2 END AS {prefix}pct_high")

    return quad, fin


def build(params: RunParams = RunParams()) -> dict[str, str]:
    W = ctes(params)
    M, R, P, T, PC = cat.MONEY, cat.RATIO, cat.PROB, cat.TOTAL, cat.PCT
    quad, fin = _kpi_select()
    pr = params.pricing
    sql: dict[str, str] = {}

    sql["clean_portfolio"] = W + """SELECT LoanID, Borrower, Sector, Geography, LoanAmount, InterestRate_clean, TermMonths,
        CreditScore, MonthlyIncome, EBITDA, CollateralValue, CurrentMarketValue, CollateralType, CollateralBase FROM clean"""
    sql["filter_domains"] = W + """SELECT dimension, value FROM (
        SELECT 'Sector' AS dimension, Sector AS value FROM clean UNION SELECT 'Geography', Geography FROM clean) t
        ORDER BY dimension, value"""
    s, g = cat.RELAX_SECTOR, cat.RELAX_GEOGRAPHY
    sql["filtered_relaxed"] = W + f""", hit AS (SELECT EXISTS (SELECT 1 FROM clean WHERE Sector = '{s}' AND Geography = '{g}') AS ok),
        eff AS (SELECT '{s}' AS eff_sector, CASE WHEN ok THEN '{g}' ELSE 'All' END AS eff_geography FROM hit)
        SELECT LoanID, Sector, Geography, eff_sector, eff_geography FROM clean CROSS JOIN eff
        WHERE (eff_sector = 'All' OR Sector = eff_sector) AND (eff_geography = 'All' OR Geography = eff_geography)"""
    issues = """SELECT LoanID, concat_ws(', ',
          CASE WHEN LoanAmount IS NULL OR LoanAmount <= 0 THEN 'LoanAmount<=0 or missing' END,
          CASE WHEN TermMonths IS NULL OR TermMonths <= 0 THEN 'TermMonths<=0 or missing' END,
          CASE WHEN InterestRate_clean IS NULL OR InterestRate_clean < 0 THEN 'Invalid InterestRate' END,
          CASE WHEN CreditScore IS NOT NULL AND (CreditScore < 300 OR CreditScore > 850) THEN 'CreditScore out of [300,850]' END,
          CASE WHEN CollateralBase IS NULL OR CollateralBase <= 0 THEN 'No collateral value' END) AS Issues FROM clean"""
    sql["data_quality"] = W + f"SELECT LoanID, Issues FROM ({issues}) t WHERE Issues <> ''"
    sql["data_quality_sample"] = W + f"SELECT LoanID, Issues FROM ({issues}) t WHERE Issues <> '' ORDER BY LoanID LIMIT 10"
    sql["preview_first10"] = W + "SELECT LoanID, Borrower, Sector, Geography, LoanAmount, TermMonths FROM clean ORDER BY LoanID LIMIT 10"

    sql["cashflows_base"] = W + f"""SELECT LoanID, {RND('MonthlyPayment', M)} AS MonthlyPayment,
        {RND('AnnualDebtService', M)} AS AnnualDebtService, {RND('Balance_12m', M)} AS Balance_12m,
        {RND('Interest_Y1', M)} AS Interest_Y1 FROM base"""
    sql["ratios_base"] = W + f"""SELECT LoanID, {RND('LTV', R)} AS LTV, {RND('DTI', R)} AS DTI, {RND('DSCR', R)} AS DSCR,
        {RND('ICR', R)} AS ICR FROM base"""
    sql["pd_lgd_ead_el_base"] = W + f"""SELECT LoanID, {RND('PD_12m', P)} AS PD_12m, {RND('LGD', P)} AS LGD,
        {RND('EAD_12m', M)} AS EAD_12m, {RND('EL_12m', M)} AS EL_12m FROM base"""
    sql["tier_cuts"] = W + f"SELECT n_pd, {RND('q_low', P)} AS q_low, {RND('q_high', P)} AS q_high FROM cuts"
    sql["tiers_base"] = W + f"SELECT LoanID, {RND('PD_12m', P)} AS PD_12m, RiskTier FROM tiered"

    def thr(limits):
        p_, l_, s_, d_ = limits
        return (f"coalesce(PD_12m >= {D(p_)}, false) OR coalesce(LTV > {D(l_)}, false) "
                f"OR coalesce(DSCR < {D(s_)}, false) OR coalesce(DTI > {D(d_)}, false)")
    sql["tiers_threshold"] = W + f"""SELECT LoanID, CASE WHEN {thr(THRESHOLD_HIGH)} THEN 'High'
        WHEN {thr(THRESHOLD_MEDIUM)} THEN 'Medium' ELSE 'Low' END AS RiskTier_threshold FROM base"""
    sql["kpis_base"] = W + f"""SELECT {RND('total_ead', T)} AS total_ead, {RND('wavg_pd', P)} AS wavg_pd,
        {RND('total_el', T)} AS total_el, {RND('pct_high', PC)} AS pct_high FROM (
        SELECT {fin('')} FROM (SELECT {quad('', 'EAD_12m', 'PD_12m', 'EL_12m', 'RiskTier')} FROM tiered) a) b"""

    stress_cols = ", ".join(f"{RND(c, d)} AS {c}" for c, d in cat.STRESS_COLUMNS)
    sql["stressed_risk"] = W + f"SELECT LoanID, Scenario, {stress_cols}, RiskTier_st FROM stressed"
    digits = {"total_ead": T, "wavg_pd": P, "total_el": T, "pct_high": PC}
    kcols = ", ".join(f"{RND(f'{p}_{m}', d)} AS {p}_{m}" for p in ("base", "st") for m, d in digits.items())
    dcols = ", ".join(f"{RND(f'st_{m} - base_{m}', d)} AS delta_{m}" for m, d in digits.items())
    sql["kpis_by_scenario"] = W + f"""SELECT Scenario, n_loans, {kcols}, {dcols} FROM (
        SELECT Scenario, n_loans, {fin('base_')}, {fin('st_')} FROM (
          SELECT Scenario, count(*) AS n_loans, {quad('base_', 'EAD_12m', 'PD_12m', 'EL_12m', 'RiskTier')},
                 {quad('st_', 'EAD_12m_st', 'PD_12m_st', 'EL_12m_st', 'RiskTier_st')}
          FROM stressed GROUP BY Scenario) a) b"""
    tier_view = """, present AS (
          SELECT Scenario, max(CASE WHEN RiskTier_st = 'High' THEN 1 ELSE 0 END) AS has_high FROM stressed GROUP BY Scenario),
        tier_view AS (SELECT s.* FROM stressed s JOIN present p ON s.Scenario = p.Scenario
                      WHERE p.has_high = 0 OR s.RiskTier_st = 'High')"""
    sql["tier_filtered_loans"] = W + tier_view + f"""
        SELECT Scenario, LoanID, RiskTier_st, {RND('EAD_12m_st', M)} AS EAD_12m_st FROM tier_view"""
    sql["kpis_tier_high"] = W + tier_view + f"""
        SELECT Scenario, n_loans, {kcols}, {dcols} FROM (
        SELECT Scenario, n_loans, {fin('base_')}, {fin('st_')} FROM (
          SELECT Scenario, count(*) AS n_loans, {quad('base_', 'EAD_12m', 'PD_12m', 'EL_12m', 'RiskTier')},
                 {quad('st_', 'EAD_12m_st', 'PD_12m_st', 'EL_12m_st', 'RiskTier_st')}
          FROM tier_view GROUP BY Scenario) a) b"""
    sql["kpis_custom_scenario"] = ctes(replace(params, scenarios=(Scenario(*cat.CUSTOM_SCENARIO),))) + f"""
        SELECT Scenario, n_loans, {kcols}, {dcols} FROM (
        SELECT Scenario, n_loans, {fin('base_')}, {fin('st_')} FROM (
          SELECT Scenario, count(*) AS n_loans, {quad('base_', 'EAD_12m', 'PD_12m', 'EL_12m', 'RiskTier')},
                 {quad('st_', 'EAD_12m_st', 'PD_12m_st', 'EL_12m_st', 'RiskTier_st')}
          FROM stressed GROUP BY Scenario) a) b"""
    sql["tier_histogram"] = W + """, hist AS (
          SELECT Scenario, 'base' AS basis, RiskTier AS tier, count(*) AS n FROM stressed GROUP BY 1, 2, 3
          UNION ALL SELECT Scenario, 'stressed', RiskTier_st, count(*) FROM stressed GROUP BY 1, 2, 3),
        dom AS (SELECT s.Scenario, b.basis, t.RiskTier, t.tier_order FROM scen s
          CROSS JOIN (VALUES ('base'), ('stressed')) b(basis)
          CROSS JOIN (VALUES ('Low', 0), ('Medium', 1), ('High', 2)) t(RiskTier, tier_order))
        SELECT d.Scenario, d.basis, d.RiskTier, CAST(d.tier_order AS INTEGER) AS tier_order, coalesce(h.n, 0) AS n_loans
        FROM dom d LEFT JOIN hist h ON d.Scenario = h.Scenario AND d.basis = h.basis AND d.RiskTier = h.tier"""
    for name, k in (("ead_by_sector", "Sector"), ("ead_by_geography", "Geography")):
        sql[name] = W + f"""SELECT Scenario, {k}, {RND('ead_st', T)} AS ead_st, rank FROM (
            SELECT Scenario, {k}, ead_st,
                   CAST(row_number() OVER (PARTITION BY Scenario ORDER BY ead_st DESC NULLS LAST, {k} ASC) AS INTEGER) AS rank
            FROM (SELECT Scenario, {k}, {SUM('EAD_12m_st')} AS ead_st FROM stressed GROUP BY Scenario, {k}) a) b
            WHERE rank <= 10"""
    sql["top3_sector_share"] = W + f""", sec AS (
          SELECT Scenario, Sector, {SUM('EAD_12m_st')} AS ead_st FROM stressed GROUP BY Scenario, Sector),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY Scenario ORDER BY ead_st DESC NULLS LAST, Sector ASC) AS rk FROM sec),
        top AS (SELECT Scenario, {SUM('ead_st')} AS top3_ead FROM ranked WHERE rk <= 3 GROUP BY Scenario),
        tot AS (SELECT Scenario, {SUM('EAD_12m_st')} AS total_ead_st FROM stressed GROUP BY Scenario)
        SELECT tot.Scenario, {RND('coalesce(top3_ead, 0e0)', T)} AS top3_ead, {RND('total_ead_st', T)} AS total_ead_st,
               {RND('CASE WHEN total_ead_st > 0 THEN top3_ead / total_ead_st * 1e2 END', PC)} AS top3_share_pct
        FROM tot LEFT JOIN top USING (Scenario)"""

    hr = ", ".join(f"{RND(h, R)} AS {h}" for h in cat.HR_COLUMNS)
    sql["covenant_table"] = W + f"""SELECT LoanID, Scenario, {hr}, Badge_st, {RND('WorstHeadroom_st', R)} AS WorstHeadroom_st,
        Tightest FROM covs"""
    sql["badge_rollup"] = W + f"""SELECT Scenario, Badge_st, Count,
        {RND('CAST(Count AS DOUBLE) / CAST(sum(Count) OVER (PARTITION BY Scenario) AS DOUBLE) * 1e2', 1)} AS Percent
        FROM (SELECT Scenario, Badge_st, count(*) AS Count FROM covs GROUP BY Scenario, Badge_st) t"""
    w4 = ", ".join(f"{RND(c, 4)} AS {c}" for c in ("WorstHeadroom_st", "DSCR_st", "LTV_st", "DTI_st", "PD_12m_st", "LGD_st"))
    sql["watchlist_top10"] = W + f"""SELECT Scenario, rank, LoanID, Badge_st, Tightest, {w4} FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY Scenario ORDER BY Badge_st ASC,
               {RND('WorstHeadroom_st', 4)} ASC NULLS LAST, LoanID ASC) AS INTEGER) AS rank
        FROM covs WHERE Badge_st IN ('Red', 'Amber')) t WHERE rank <= 10"""
    ex = ", ".join(f"{RND(c, R)} AS {c}" for c in ("DSCR_st", "ICR_st", "LTV_st", "DTI_st"))
    sql["exceptions"] = W + f"""SELECT Scenario, LoanID, Borrower, Sector, Geography, {ex}, Badge_st,
        {RND('WorstHeadroom_st', R)} AS WorstHeadroom_st FROM covs WHERE Badge_st IN ('Red', 'Amber')"""

    sql["amortisation_schedule"] = W + f"""SELECT Scenario, CAST(month AS INTEGER) AS month, count(*) AS n_loans,
        {RND('sum(ob)', T)} AS opening_balance, {RND('sum(loss_pv)', M)} AS loss_pv
        FROM sched_st GROUP BY Scenario, month"""
    all_sums = ", ".join(f"{RND(SUM(a), dg)} AS {b}" for a, b, dg in (
        ("ob", "opening_balance", T), ("interest", "interest", T), ("principal", "principal", T), ("survival", "survival", 6),
        ("default_mass", "default_mass", 6), ("loss", "loss", M), ("loss_pv", "loss_pv", M)))
    sql["amortisation_columns"] = W + f"""SELECT 'base' AS basis, CAST(month AS INTEGER) AS month, count(*) AS n_loans, {all_sums}
        FROM sched_base WHERE Scenario = 'Base' GROUP BY month
        UNION ALL SELECT 'stressed', CAST(month AS INTEGER), count(*), {all_sums}
        FROM sched_st WHERE Scenario = 'Severe' GROUP BY month"""
    sql["ratios_noi"] = W + f"""SELECT LoanID, {RND('(EBITDA * 1.5e0) / nullif(AnnualDebtService, 0)', R)} AS DSCR FROM base"""
    sql["watchlist_tab"] = W + f"""SELECT Scenario, rank, LoanID, Badge_st, {RND('PD_12m_st * 1e2', 2)} AS PD_12m_st,
        {RND('LGD_st * 1e2', 2)} AS LGD_st, {", ".join(f"{RND(c, 4)} AS {c}" for c in
        ("WorstHeadroom_st", "DSCR_st", "LTV_st", "DTI_st", "EL_12m_st"))} FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY Scenario ORDER BY Badge_st ASC,
               {RND('WorstHeadroom_st', 10)} ASC NULLS LAST, LoanID ASC) AS INTEGER) AS rank
        FROM covs WHERE Badge_st IN ('Red', 'Amber')) t WHERE rank <= 10"""
    sql["filtered_sector_relaxed"] = W + f""", eff AS (SELECT CASE WHEN EXISTS (
          SELECT 1 FROM clean WHERE Sector = '{cat.NO_SECTOR}') THEN '{cat.NO_SECTOR}' ELSE 'All' END AS eff_sector)
        SELECT LoanID, Sector, Geography, eff_sector, 'All' AS eff_geography FROM clean CROSS JOIN eff
        WHERE eff_sector = 'All' OR Sector = eff_sector"""
    sql["generated_ids"] = W + """SELECT count(*) AS n_loans, count(*) AS n_ids, CAST(1 AS BIGINT) AS first_id,
        count(*) AS last_id FROM loans"""
    # What each planted string must become, stated value by value.
    amounts = "1000e0, 2500.5e0, 1000e0, NULL, NULL, NULL, -5e0, 0.5e0, 5e0, NULL, NULL"
    rates = "NULL, NULL, 0.05e0, 0.05e0, 1e0, 0.0101e0, NULL"
    sql["coerced_strings"] = f"""SELECT concat('L-', CAST(o_orderkey AS VARCHAR)) AS LoanID,
        list_extract([{amounts}], CAST(o_orderkey % 11 + 1 AS INTEGER)) AS LoanAmount,
        {RND(f'list_extract([{rates}], CAST(o_orderkey % 7 + 1 AS INTEGER))', 10)} AS InterestRate_clean,
        list_extract([60, 60, NULL, NULL, NULL], CAST(o_orderkey % 5 + 1 AS INTEGER)) AS TermMonths FROM orders"""
    sql["lifetime_el"] = W + f"""SELECT LoanID, Scenario, {RND('EL_life_base', M)} AS EL_life_base,
        {RND('EL_life_st', M)} AS EL_life_st FROM life"""
    sql["lifetime_totals"] = W + f"""SELECT Scenario, {RND('b', T)} AS el_life_base, {RND('s', T)} AS el_life_st,
        {RND('s - b', T)} AS delta_life, {RND('p', T)} AS start_ead,
        {RND('CASE WHEN p > 0 THEN b / p * 1e2 END', PC)} AS pct_life_base,
        {RND('CASE WHEN p > 0 THEN s / p * 1e2 END', PC)} AS pct_life_st,
        {RND('CASE WHEN p > 0 THEN s / p * 1e2 END - CASE WHEN p > 0 THEN b / p * 1e2 END', PC)} AS delta_pct
        FROM (SELECT Scenario, {SUM('EL_life_base')} AS b, {SUM('EL_life_st')} AS s,
                     {SUM('LoanAmount')} AS p FROM life GROUP BY Scenario) t"""

    def price_cols(extra=""):
        return (f"Scenario, {extra}LoanID, {RND('PD_12m_st * 1e2', 2)} AS PD_12m_st, {RND('LGD_st * 1e2', 2)} AS LGD_st, "
                f"{RND('EAD_12m_st', 2)} AS EAD_12m_st, {RND('EL_12m_st', 2)} AS EL_12m_st, "
                f"{RND(RND('EL_rate_st', 10) + ' * 1e2', 2)} AS EL_rate_st, "
                f"{RND(RND('SuggestedSpread_bps', 6), 0)} AS SuggestedSpread_bps, "
                f"{RND(RND('SuggestedAllInRate_pct', 8), 2)} AS SuggestedAllInRate_pct")
    sql["pricing_table"] = W + f"SELECT {price_cols()} FROM pricing"
    sql["portfolio_pricing"] = W + f"""SELECT Scenario, {RND('el_rate', P)} AS el_rate, {RND('sp * 1e2', 4)} AS spread_bps,
        {RND(f'{D(pr.funding_cost_pct)} + sp', PC)} AS allin_pct FROM (
          SELECT Scenario, el_rate, el_rate * 1e2 + {D(pr.cap_buffer_pct)} + {D(pr.opex_pct)}
                 + {D(pr.target_profit_pct)} AS sp FROM (
            SELECT Scenario, CASE WHEN e > 0 THEN l / e END AS el_rate FROM (
              SELECT Scenario, {SUM('EAD_12m_st')} AS e, {SUM('EL_12m_st')} AS l
              FROM stressed GROUP BY Scenario) a) b) c"""

    def ranked(measure):
        return f"""SELECT Scenario, rank, LoanID, Borrower, Sector, Geography, {RND('EAD_12m_st', M)} AS EAD_12m_st,
            {RND('EL_12m_st', M)} AS EL_12m_st, {RND('PD_12m_st * 1e2', 2)} AS PD_12m_st,
            {RND('LGD_st * 1e2', 2)} AS LGD_st, RiskTier_st FROM (
              SELECT *, CAST(row_number() OVER (PARTITION BY Scenario ORDER BY {measure} DESC NULLS LAST, LoanID ASC) AS INTEGER) AS rank
              FROM stressed) t WHERE rank <= 10"""
    sql["top_ead"] = W + ranked("EAD_12m_st")
    sql["top_el"] = W + ranked("EL_12m_st")
    sql["top_spread"] = W + f"""SELECT {price_cols('rank, ')} FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY Scenario ORDER BY SuggestedSpread_bps DESC NULLS LAST, LoanID ASC) AS INTEGER) AS rank
        FROM pricing) t WHERE rank <= 10"""
    sql["masked_report"] = W + f"""SELECT Scenario, concat('****', right(LoanID, 4)) AS LoanID,
        regexp_replace(Borrower, '(.)(.*)', '\\1***') AS Borrower, Sector, Geography,
        {RND('EAD_12m_st', M)} AS EAD_12m_st, {RND('EL_12m_st', M)} AS EL_12m_st,
        {RND('PD_12m_st * 1e2', 2)} AS PD_12m_st, {RND('LGD_st * 1e2', 2)} AS LGD_st, RiskTier_st FROM stressed"""

    money = ", ".join(f"{RND(c, 2)} AS {c}" for c in ("MonthlyPayment", "AnnualDebtService", "Balance_12m", "Interest_Y1"))
    ratios = ", ".join(f"{RND(c, 4)} AS {c}" for c in ("LTV", "DTI", "DSCR", "ICR"))
    sql["derived_metrics_display"] = W + f"""SELECT LoanID, Borrower, Sector, Geography, {RND('LoanAmount', 2)} AS LoanAmount,
        InterestRate_clean * 1e2 AS "InterestRate_%", TermMonths, {money}, {ratios} FROM tiered"""
    sql["base_risk_display"] = W + f"""SELECT LoanID, {RND('PD_12m * 1e2', 2)} AS PD_12m, {RND('LGD * 1e2', 2)} AS LGD,
        {RND('EAD_12m', 2)} AS EAD_12m, {RND('EL_12m', 2)} AS EL_12m, RiskTier FROM tiered"""
    sql["stressed_risk_display"] = W + f"""SELECT Scenario, LoanID, {RND('PD_12m_st * 1e2', 2)} AS PD_12m_st,
        {RND('LGD_st * 1e2', 2)} AS LGD_st, {RND('EAD_12m_st', 2)} AS EAD_12m_st, {RND('EL_12m_st', 2)} AS EL_12m_st,
        RiskTier_st FROM stressed"""
    cov4 = ", ".join(f"{RND(c, 4)} AS {c}" for c in ("DSCR_st", "ICR_st", "LTV_st", "DTI_st", "HR_DSCR_st", "HR_ICR_st",
                                                       "HR_LTV_st", "HR_DTI_st", "WorstHeadroom_st"))
    sql["covenant_display"] = W + f"SELECT Scenario, LoanID, Badge_st, {cov4} FROM covs"
    return sql

