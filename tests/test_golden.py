"""The bundled 10-loan sample against independently computed values (FIXTURES.md §2)."""

import pytest

from creditspark.operators import aggregates as A
from creditspark.operators.covenants import watchlist
from creditspark.params import RunParams
from creditspark.plans.portfolio import run_portfolio
from creditspark.sources.sample import sample_portfolio, template_portfolio

BASE = {  # LoanID: Payment, Balance_12m, LTV, DTI, DSCR, PD, LGD, EAD, EL, lifetime EL, tier, badge
    "L-001": (4891.54, 206263.83, 0.7353, 0.2223, 4.4976, 0.0079, 0.3268, 228131.92, 590.46, 1547.97, "Low", "Green"),
    "L-004": (3866.43, 83872.73, 1.3333, 0.3222, 3.1036, 0.0396, 0.7300, 101936.37, 2946.78, 5152.95, "Medium", "Red"),
    "L-008": (6948.01, 412083.62, 1.1842, 0.2895, 3.4542, 0.1800, 0.4680, 431041.81, 36310.96, 102653.82, "High", "Red"),
    "L-010": (5653.03, 218723.76, 2.6000, 0.4348, 2.2997, 0.2400, 0.8615, 239361.88, 49492.67, 101834.64, "High", "Red"),
}
SEVERE = {
    "L-002": (7731.04, 562018.82, 0.9091, 0.1546, 6.4674, 0.0135, 0.3070, 581009.41, 2407.99, 11320.74, "Low", "Red"),
    "L-009": (5126.64, 106776.43, 4.0000, 0.5127, 1.9506, 0.5250, 0.9100, 128388.22, 61337.47, 83509.50, "High", "Red"),
}
PORTFOLIO = {  # Σ EAD, wavg PD, Σ EL, high %, Σ lifetime EL, lifetime %, spread bps, all-in %
    "Base": (2828579.57, 0.084346, 148781.77, 44.9622, 339809.92, 11.2148, 725.9946, 10.2599),
    "Adverse": (2833867.39, 0.107833, 198851.40, 44.9598, 439356.61, 14.5002, 901.6962, 12.0170),
    "Severe": (2841580.23, 0.135744, 272283.32, 44.9565, 578604.07, 19.0958, 1158.2109, 14.5821),
}


@pytest.fixture(scope="module")
def run(spark):
    return run_portfolio(spark, sample_portfolio(spark), RunParams())


@pytest.fixture(scope="module")
def full(run):
    rows = run.full().collect()
    return {(r["Scenario"], r["LoanID"]): r for r in rows}


def _check(row, exp, sfx):
    pay, bal, ltv, dti, dscr, pd, lgd, ead, el, life, tier, badge = exp
    assert round(row["MonthlyPayment" + sfx], 2) == pay
    assert round(row["Balance_12m" + sfx], 2) == bal
    assert round(row["LTV" + sfx], 4) == ltv
    assert round(row["DTI" + sfx], 4) == dti
    assert round(row["DSCR" + sfx], 4) == dscr
    assert round(row["PD_12m" + sfx], 4) == pd
    assert round(row["LGD" + sfx], 4) == lgd
    assert round(row["EAD_12m" + sfx], 2) == ead
    assert round(row["EL_12m" + sfx], 2) == el
    assert round(row["EL_life_base" if sfx == "" else "EL_life_st"], 2) == life
    assert row["RiskTier" + sfx] == tier
    assert row["Badge_st"] == badge or sfx == ""


def test_cuts(run):
    c = run.cuts.collect()[0]
    assert round(c["q_low"], 7) == 0.0337026 and round(c["q_high"], 6) == 0.068688


def test_base_loans(full):
    for loan, exp in BASE.items():
        row = full[("Base", loan)]
        _check(row, exp, "")
        assert row["Badge_st"] == exp[-1]


def test_severe_loans(full):
    for loan, exp in SEVERE.items():
        _check(full[("Severe", loan)], exp, "_st")


def test_portfolio(run, spark):
    k = {r["Scenario"]: r for r in A.kpis_by_scenario(run.view).collect()}
    life = {r["Scenario"]: r for r in A.lifetime_totals(run.lifetime()).collect()}
    price = {r["Scenario"]: r for r in A.portfolio_pricing(run.view).collect()}
    for scen, (ead, wpd, el, high, lt, ltp, bps, allin) in PORTFOLIO.items():
        assert round(k[scen]["st_total_ead"], 2) == ead
        assert round(k[scen]["st_wavg_pd"], 6) == wpd
        assert round(k[scen]["st_total_el"], 2) == el
        assert round(k[scen]["st_pct_high"], 4) == high
        assert round(life[scen]["el_life_st"], 2) == lt
        assert round(life[scen]["pct_life_st"], 4) == ltp
        assert round(price[scen]["spread_bps"], 4) == bps
        assert round(price[scen]["allin_pct"], 4) == allin
        assert k[scen]["n_loans"] == 10


def test_tiers_and_badges(run):
    hist = {(r["Scenario"], r["basis"], r["RiskTier"]): r["n_loans"] for r in A.tier_histogram(run.view).collect()}
    for scen in PORTFOLIO:
        assert [hist[(scen, "stressed", t)] for t in ("Low", "Medium", "High")] == [3, 3, 4]
    badges = {(r["Scenario"], r["Badge_st"]): r["Count"] for r in A.badge_rollup(run.covenants()).collect()}
    assert badges[("Base", "Red")] == 7 and badges[("Base", "Green")] == 3
    assert badges[("Adverse", "Red")] == 7 and badges[("Adverse", "Amber")] == 2 and badges[("Adverse", "Green")] == 1
    assert badges[("Severe", "Red")] == 10


def test_watchlist_reference_order(run):
    w = watchlist(run.covenants()).where("Scenario = 'Adverse'").orderBy("rank").collect()
    assert [r["LoanID"] for r in w] == ["L-001", "L-003", "L-009", "L-010", "L-005", "L-004", "L-006", "L-008", "L-007"]
    assert all(r["Tightest"] == "LTV" for r in w)
    sev = watchlist(run.covenants(), severity_first=True).where("Scenario = 'Adverse'").orderBy("rank").collect()
    assert sev[0]["Badge_st"] == "Red" and sev[-1]["Badge_st"] == "Amber"


def test_top3_sectors(run):
    top = A.ead_by(run.view, "Sector", 3).where("Scenario = 'Base'").orderBy("rank").collect()
    assert [r["Sector"] for r in top] == ["Real Estate", "Construction", "Hospitality"]
    share = {r["Scenario"]: r for r in A.top3_sector_share(run.view).collect()}
    assert round(share["Base"]["top3_share_pct"], 4) == 52.4306


def test_template_three_rows(spark):
    run = run_portfolio(spark, template_portfolio(spark))
    c = run.cuts.collect()[0]
    assert (c["q_low"], c["q_high"]) == (0.02, 0.06)
    rows = run.base.select("DSCR", "ICR").collect()
    assert all(r["DSCR"] is None and r["ICR"] is None for r in rows)


def test_materialized_base_gives_same_kpis(spark, run):
    m = run_portfolio(spark, sample_portfolio(spark), RunParams(materialize_base=True))
    a = sorted(tuple(r) for r in A.kpis_by_scenario(run.view).collect())
    b = sorted(tuple(r) for r in A.kpis_by_scenario(m.view).collect())
    assert a == b
