"""Named queries over the driver tables: one per operator group of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame. Outputs are
rounded with NumPy's rule (scale, round half even) at fixed digits, which is
also how the reference displays its tables; ``plans.oracle`` holds the
matching DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import np_round
from ..functions.sums import exact_sum
from ..operators import aggregates as agg
from ..operators.clean import clean
from ..operators.covenants import exceptions
from ..operators.enrich import enrich_base
from ..operators.filters import filter_domains, filter_portfolio
from ..operators.lifetime import amortisation_schedule, schedule_by_month
from ..operators.quality import issue_sample, issues
from ..operators.rankings import preview, top_k
from ..operators.report import (
    display_base_risk, display_covenants, display_derived_base, display_lifetime, display_pricing,
    display_stressed_risk, display_top, display_watchlist_report, display_watchlist_tab, mask_pii,
)
from ..operators.tiers import tier_cuts, with_threshold_tier
from ..params import RunParams, Scenario
from ..plans.portfolio import PortfolioRun, run_portfolio
from ..sources.testdata import loans, read_table

# Digits used in query outputs. Output column names throughout this module are
# fixed values: they are the reference's names.
MONEY, RATIO, PROB, TOTAL, PCT = 2, 6, 8, 2, 6
# Filter request used by the relaxation query: a geography with no loans.
RELAX_SECTOR, RELAX_GEOGRAPHY = "Construction", "ATLANTIS"
# A sector without loans, and a scenario of one's own: falling rates, and more
# unemployment than any preset.
NO_SECTOR = "Mining"
CUSTOM_SCENARIO = ("Custom", -150, 18, 30)


def _r(name: str, digits: int) -> Column:
    return np_round(F.col(name), digits).alias(name)


def _run(spark: SparkSession, sf_dir: str, params: RunParams = RunParams()) -> PortfolioRun:
    return run_portfolio(spark, loans(spark, sf_dir), params)


def _clean(spark, sf_dir) -> DataFrame:
    return clean(loans(spark, sf_dir))


# --- cleaning, filters, quality ---------------------------------------------------

def clean_portfolio(spark, sf_dir):
    return _clean(spark, sf_dir)


def filter_domains_q(spark, sf_dir):
    return filter_domains(_clean(spark, sf_dir))


def filtered_relaxed(spark, sf_dir):
    df, eff = filter_portfolio(_clean(spark, sf_dir), RELAX_SECTOR, RELAX_GEOGRAPHY)
    return df.select(
        "LoanID", "Sector", "Geography",
        eff.sector_column.alias("eff_sector"), eff.geography_column.alias("eff_geography"),
    )


def filtered_sector_relaxed(spark, sf_dir):
    df, eff = filter_portfolio(_clean(spark, sf_dir), NO_SECTOR)
    return df.select("LoanID", "Sector", "Geography", eff.sector_column.alias("eff_sector"),
                     eff.geography_column.alias("eff_geography"))


# Strings as files hold them; the oracle states what each must become.
AMOUNT_TEXTS = ("1000", " 2500.5 ", "1e3", "1d", "abc", "", "-5", ".5", "5.", "1e400", None)
RATE_TEXTS = ("7.5%", "7,5", "0.05", "5", "1.0", "1.01", "x")
TERM_TEXTS = ("60", "60.9", "0.5", "-3", "text")


def coerced_strings(spark, sf_dir):
    """P2, P3, P5 on string columns, one loan per order."""
    k = F.col("o_orderkey")

    def text(values):
        return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % len(values) + 1).cast("int"))

    raw = read_table(spark, sf_dir, "orders").select(
        F.concat(F.lit("L-"), k.cast("string")).alias("LoanID"), text(AMOUNT_TEXTS).alias("LoanAmount"),
        text(RATE_TEXTS).alias("InterestRate"), text(TERM_TEXTS).alias("TermMonths"))
    return clean(raw).select("LoanID", "LoanAmount", _r("InterestRate_clean", 10), "TermMonths")


def generated_ids(spark, sf_dir):
    """Ids of a table without LoanID are unique and dense."""
    number = F.regexp_extract("LoanID", "^L-([0-9]+)$", 1).cast("long")
    ids = clean(loans(spark, sf_dir).drop("LoanID")).select(number.alias("id"))
    return ids.agg(F.count(F.lit(1)).alias("n_loans"), F.countDistinct("id").alias("n_ids"),
                   F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def data_quality(spark, sf_dir):
    return issues(_clean(spark, sf_dir))


def data_quality_sample(spark, sf_dir):
    return issue_sample(issues(_clean(spark, sf_dir)))


def preview_first10(spark, sf_dir):
    return preview(_clean(spark, sf_dir)).select("LoanID", "Borrower", "Sector", "Geography", "LoanAmount", "TermMonths")


# --- base metrics -----------------------------------------------------------------

def cashflows_base(spark, sf_dir):
    base = enrich_base(_clean(spark, sf_dir))
    return base.select("LoanID", *[_r(c, MONEY) for c in ("MonthlyPayment", "AnnualDebtService", "Balance_12m", "Interest_Y1")])


def ratios_base(spark, sf_dir):
    base = enrich_base(_clean(spark, sf_dir))
    return base.select("LoanID", *[_r(c, RATIO) for c in ("LTV", "DTI", "DSCR", "ICR")])


def ratios_noi(spark, sf_dir):
    """C7 where the table has an NOI column."""
    with_noi = loans(spark, sf_dir).withColumn("NOI", F.col("EBITDA") * F.lit(1.5))
    return enrich_base(clean(with_noi)).select("LoanID", _r("DSCR", RATIO))


def pd_lgd_ead_el_base(spark, sf_dir):
    base = enrich_base(_clean(spark, sf_dir))
    return base.select("LoanID", _r("PD_12m", PROB), _r("LGD", PROB), _r("EAD_12m", MONEY), _r("EL_12m", MONEY))


def tier_cuts_q(spark, sf_dir):
    return tier_cuts(enrich_base(_clean(spark, sf_dir))).select("n_pd", _r("q_low", PROB), _r("q_high", PROB))


def tiers_base(spark, sf_dir):
    return _run(spark, sf_dir).base.select("LoanID", _r("PD_12m", PROB), "RiskTier")


def tiers_threshold(spark, sf_dir):
    return with_threshold_tier(enrich_base(_clean(spark, sf_dir))).select("LoanID", "RiskTier_threshold")


def kpis_base(spark, sf_dir):
    k = _run(spark, sf_dir).kpis_base()
    return k.select(_r("total_ead", TOTAL), _r("wavg_pd", PROB), _r("total_el", TOTAL), _r("pct_high", PCT))


# --- stress -----------------------------------------------------------------------

STRESS_COLUMNS = (
    ("InterestRate_st", 10), ("MonthlyPayment_st", MONEY), ("Balance_12m_st", MONEY), ("LTV_st", RATIO),
    ("DTI_st", RATIO), ("DSCR_st", RATIO), ("ICR_st", RATIO), ("PD_12m_st", PROB), ("LGD_st", PROB),
    ("EAD_12m_st", MONEY), ("EL_12m_st", MONEY),
)


def stressed_risk(spark, sf_dir):
    v = _run(spark, sf_dir).view
    return v.select("LoanID", "Scenario", *[_r(c, d) for c, d in STRESS_COLUMNS], "RiskTier_st")


def kpis_by_scenario(spark, sf_dir):
    k = _run(spark, sf_dir).kpis()
    digits = {"total_ead": TOTAL, "wavg_pd": PROB, "total_el": TOTAL, "pct_high": PCT}
    cols = [_r(f"{p}_{m}", d) for p in ("base", "st", "delta") for m, d in digits.items()]
    return k.select("Scenario", "n_loans", *cols)


def kpis_custom_scenario(spark, sf_dir):
    """A scenario of the user's own instead of the presets."""
    k = _run(spark, sf_dir, RunParams(scenarios=(Scenario(*CUSTOM_SCENARIO),))).kpis()
    digits = {"total_ead": TOTAL, "wavg_pd": PROB, "total_el": TOTAL, "pct_high": PCT}
    cols = [_r(f"{p}_{m}", d) for p in ("base", "st", "delta") for m, d in digits.items()]
    return k.select("Scenario", "n_loans", *cols)


def kpis_tier_high(spark, sf_dir):
    """KPIs over the stressed High tier (per scenario; all loans where a
    scenario has no High loan)."""
    k = _run(spark, sf_dir, RunParams(tier="High")).kpis()
    digits = {"total_ead": TOTAL, "wavg_pd": PROB, "total_el": TOTAL, "pct_high": PCT}
    cols = [_r(f"{p}_{m}", d) for p in ("base", "st", "delta") for m, d in digits.items()]
    return k.select("Scenario", "n_loans", *cols)


def tier_filtered_loans(spark, sf_dir):
    """F4 on the loans themselves."""
    v = _run(spark, sf_dir, RunParams(tier="High")).view
    return v.select("Scenario", "LoanID", "RiskTier_st", _r("EAD_12m_st", MONEY))


def tier_histogram(spark, sf_dir):
    return _run(spark, sf_dir).tier_histogram()


def ead_by_sector(spark, sf_dir):
    return agg.ead_by(_run(spark, sf_dir).view, "Sector").select("Scenario", "Sector", _r("ead_st", TOTAL), "rank")


def ead_by_geography(spark, sf_dir):
    return agg.ead_by(_run(spark, sf_dir).view, "Geography").select("Scenario", "Geography", _r("ead_st", TOTAL), "rank")


def top3_sector_share(spark, sf_dir):
    s = agg.top3_sector_share(_run(spark, sf_dir).view)
    return s.select("Scenario", _r("top3_ead", TOTAL), _r("total_ead_st", TOTAL), _r("top3_share_pct", PCT))


# --- covenants --------------------------------------------------------------------

HR_COLUMNS = ("HR_DSCR_st", "HR_ICR_st", "HR_LTV_st", "HR_DTI_st")


def covenant_table(spark, sf_dir):
    c = _run(spark, sf_dir).covenants()
    return c.select("LoanID", "Scenario", *[_r(h, RATIO) for h in HR_COLUMNS], "Badge_st",
                    _r("WorstHeadroom_st", RATIO), "Tightest")


def badge_rollup(spark, sf_dir):
    return agg.badge_rollup(_run(spark, sf_dir).covenants())


def watchlist_top10(spark, sf_dir):
    return display_watchlist_report(_run(spark, sf_dir).watchlist())


def watchlist_tab(spark, sf_dir):
    """V6 as the covenant tab shows it: ranked by the unrounded headroom."""
    return display_watchlist_tab(_run(spark, sf_dir).watchlist(report_rounding=False))


def exceptions_q(spark, sf_dir):
    e = exceptions(_run(spark, sf_dir).covenants())
    return e.select("Scenario", "LoanID", "Borrower", "Sector", "Geography",
                    *[_r(c, RATIO) for c in ("DSCR_st", "ICR_st", "LTV_st", "DTI_st")], "Badge_st",
                    _r("WorstHeadroom_st", RATIO))


# --- lifetime ---------------------------------------------------------------------

def amortisation_schedule_q(spark, sf_dir):
    """L2 summed by month, through cohorts."""
    run = _run(spark, sf_dir)
    by_month = schedule_by_month(run.view, run.params.discount_rate, stressed=True)
    return by_month.select("Scenario", "month", "n_loans", _r("opening_balance", TOTAL), _r("loss_pv", MONEY))


def amortisation_columns(spark, sf_dir):
    """L2 with all its columns, of the base loans and of the severe scenario."""
    run = _run(spark, sf_dir)
    digits = {"opening_balance": TOTAL, "interest": TOTAL, "principal": TOTAL, "survival": 6, "default_mass": 6,
              "loss": MONEY, "loss_pv": MONEY}

    def by_month(df, basis):
        sums = df.groupBy("month").agg(F.count(F.lit(1)).alias("n_loans"), *[exact_sum(c).alias(c) for c in digits])
        return sums.select(F.lit(basis).alias("basis"), "month", "n_loans", *[_r(c, d) for c, d in digits.items()])

    severe = run.scenarios.where("Scenario = 'Severe'")
    return by_month(amortisation_schedule(run.enriched, run.params.discount_rate, stressed=False), "base").unionByName(
        by_month(amortisation_schedule(severe, run.params.discount_rate, stressed=True), "stressed"))


def lifetime_el(spark, sf_dir):
    return display_lifetime(_run(spark, sf_dir).lifetime())


def lifetime_totals(spark, sf_dir):
    t = agg.lifetime_totals(_run(spark, sf_dir).lifetime())
    return t.select("Scenario", *[_r(c, TOTAL) for c in ("el_life_base", "el_life_st", "delta_life", "start_ead")],
                    *[_r(c, PCT) for c in ("pct_life_base", "pct_life_st", "delta_pct")])


# --- pricing and rankings ---------------------------------------------------------

def _steady(priced: DataFrame) -> DataFrame:
    """Rates without the last digits, which differ between engines' powers: a
    value on a display tie would else show either neighbour."""
    digits = {"EL_rate_st": 10, "SuggestedSpread_bps": 6, "SuggestedAllInRate_pct": 8}
    return priced.withColumns({c: np_round(F.col(c), d) for c, d in digits.items()})


def pricing_table(spark, sf_dir):
    return display_pricing(_steady(_run(spark, sf_dir).pricing()))


def portfolio_pricing(spark, sf_dir):
    p = agg.portfolio_pricing(_run(spark, sf_dir).view)
    return p.select("Scenario", _r("el_rate", PROB), _r("spread_bps", 4), _r("allin_pct", PCT))




def _ranked(df: DataFrame, measure: str) -> DataFrame:
    return display_top(top_k(df, measure, 10))


def top_ead(spark, sf_dir):
    return _ranked(_run(spark, sf_dir).view, "EAD_12m_st")


def top_el(spark, sf_dir):
    return _ranked(_run(spark, sf_dir).view, "EL_12m_st")


def top_spread(spark, sf_dir):
    t = top_k(_run(spark, sf_dir).pricing(), "SuggestedSpread_bps", 10)
    return display_pricing(_steady(t), extra=("rank",))


def masked_report(spark, sf_dir):
    v = mask_pii(_run(spark, sf_dir).view)
    return v.select(
        "Scenario", "LoanID", "Borrower", "Sector", "Geography",
        _r("EAD_12m_st", MONEY), _r("EL_12m_st", MONEY),
        np_round(F.col("PD_12m_st") * F.lit(100.0), 2).alias("PD_12m_st"),
        np_round(F.col("LGD_st") * F.lit(100.0), 2).alias("LGD_st"),
        "RiskTier_st",
    )


# --- display projections (P8) -------------------------------------------------------

def derived_metrics_display(spark, sf_dir):
    return display_derived_base(_run(spark, sf_dir).base)


def base_risk_display(spark, sf_dir):
    return display_base_risk(_run(spark, sf_dir).base)


def stressed_risk_display(spark, sf_dir):
    return display_stressed_risk(_run(spark, sf_dir).view)


def covenant_display(spark, sf_dir):
    return display_covenants(_run(spark, sf_dir).covenants())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "clean_portfolio": clean_portfolio,
    "filter_domains": filter_domains_q,
    "filtered_relaxed": filtered_relaxed,
    "filtered_sector_relaxed": filtered_sector_relaxed,
    "coerced_strings": coerced_strings,
    "generated_ids": generated_ids,
    "data_quality": data_quality,
    "data_quality_sample": data_quality_sample,
    "preview_first10": preview_first10,
    "cashflows_base": cashflows_base,
    "ratios_base": ratios_base,
    "ratios_noi": ratios_noi,
    "pd_lgd_ead_el_base": pd_lgd_ead_el_base,
    "tier_cuts": tier_cuts_q,
    "tiers_base": tiers_base,
    "tiers_threshold": tiers_threshold,
    "kpis_base": kpis_base,
    "stressed_risk": stressed_risk,
    "kpis_by_scenario": kpis_by_scenario,
    "kpis_tier_high": kpis_tier_high,
    "tier_filtered_loans": tier_filtered_loans,
    "kpis_custom_scenario": kpis_custom_scenario,
    "tier_histogram": tier_histogram,
    "ead_by_sector": ead_by_sector,
    "ead_by_geography": ead_by_geography,
    "top3_sector_share": top3_sector_share,
    "covenant_table": covenant_table,
    "badge_rollup": badge_rollup,
    "watchlist_top10": watchlist_top10,
    "watchlist_tab": watchlist_tab,
    "exceptions": exceptions_q,
    "amortisation_schedule": amortisation_schedule_q,
    "amortisation_columns": amortisation_columns,
    "lifetime_el": lifetime_el,
    "lifetime_totals": lifetime_totals,
    "pricing_table": pricing_table,
    "portfolio_pricing": portfolio_pricing,
    "top_ead": top_ead,
    "top_el": top_el,
    "top_spread": top_spread,
    "masked_report": masked_report,
    "derived_metrics_display": derived_metrics_display,
    "base_risk_display": base_risk_display,
    "stressed_risk_display": stressed_risk_display,
    "covenant_display": covenant_display,
}
