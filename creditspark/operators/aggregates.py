"""Portfolio aggregates.

Every aggregate is keyed by scenario (a handful of groups, each possibly
holding all loans). Spark's hash aggregate combines map-side first, so only
one partial row per scenario and task is shuffled, however hot a scenario is.
Sector / geography roll-ups likewise shuffle partials, not loans. Money is summed
exactly (``functions.sums``), so totals do not depend on the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import np_round
from ..functions.scoring import tier_from_key, tier_key
from ..functions.sums import exact_sum, exact_units, large_sum, units_to_double
from ..params import Pricing
from .tiers import with_window_cuts

TIER_ORDER = ("Low", "Medium", "High")


# pandas ``sum``: NULLs skipped, an all-NULL or empty sum is 0; equal at any partitioning.
_sum0 = exact_sum


def kpi_aggs(ead: str, pd_: str, el: str, tier: str, prefix: str) -> list[Column]:
    e = F.col(ead)
    return [
        _sum0(e).alias(f"{prefix}total_ead"),
        _sum0(F.col(pd_) * e).alias(f"_{prefix}pd_ead"),
        _sum0(F.col(el)).alias(f"{prefix}total_el"),
        _sum0(F.when(F.col(tier) == "High", e)).alias(f"_{prefix}high_ead"),
    ]


def kpi_finish(prefix: str) -> list[Column]:
    total = F.col(f"{prefix}total_ead")
    pos = total > 0
    return [
        total.alias(f"{prefix}total_ead"),
        F.when(pos, F.col(f"_{prefix}pd_ead") / F.when(pos, total)).alias(f"{prefix}wavg_pd"),
        F.col(f"{prefix}total_el").alias(f"{prefix}total_el"),
        F.when(pos, F.col(f"_{prefix}high_ead") / F.when(pos, total) * F.lit(100.0)).alias(f"{prefix}pct_high"),
    ]


_SIDES = (("base_", "", "tx"), ("st_", "_st", "tx_st"))


def _grouped(df: DataFrame, by: list[str], sides) -> DataFrame:
    """Sums and counts per ``by`` and tier key(s): the one pass over the loans.
    PDs are discrete, so the keys and with them the table are few. Sums stay
    whole numbers (``functions.sums``) until the table is summed up."""
    keys = [tier_key(F.col(f"PD_12m{sfx}")).alias(tx) for _, sfx, tx in sides]
    sums = []
    for prefix, sfx, _ in sides:
        e = F.col(f"EAD_12m{sfx}")
        for name, c in (("ead", e), ("pd_ead", F.col(f"PD_12m{sfx}") * e), ("el", F.col(f"EL_12m{sfx}"))):
            sums += [exact_units(c).alias(f"{prefix}{name}"), large_sum(c).alias(f"{prefix}{name}_large")]
    return df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("n_loans"), *sums)


def _tiered(grouped: DataFrame, by: list[str], sides) -> DataFrame:
    df = with_window_cuts(grouped, by)
    for prefix, _, tx in sides:
        df = df.withColumn(f"{prefix}tier", tier_from_key(tx, F.col("q_low"), F.col("q_high")))
    return df


def _totals(prefix: str) -> list[Column]:
    high = F.col(f"{prefix}tier") == "High"

    def total(name: str, where: Column | None = None) -> Column:
        of = lambda c: F.col(c) if where is None else F.when(where, F.col(c))
        units = F.coalesce(F.sum(of(f"{prefix}{name}")), F.lit(0)).cast("decimal(38,0)")
        return units_to_double(units) + F.coalesce(F.sum(of(f"{prefix}{name}_large")), F.lit(0.0))

    return [
        total("ead").alias(f"{prefix}total_ead"),
        total("pd_ead").alias(f"_{prefix}pd_ead"),
        total("el").alias(f"{prefix}total_el"),
        total("ead", high).alias(f"_{prefix}high_ead"),
    ]


def tier_table(scenarios: DataFrame, tier: str = "All") -> DataFrame:
    """The grouped table of a stressed run, percentile tiers assigned from it,
    in one pass over ``scenarios`` (one row per loan and scenario, no tiers
    needed). Cuts come from all loans of a scenario, which are the base loans;
    ``tier`` then keeps one stressed tier where it occurs (F4)."""
    df = _tiered(_grouped(scenarios, ["Scenario"], _SIDES), ["Scenario"], _SIDES)
    if tier == "All":
        return df
    chosen = F.col("st_tier") == tier
    present = F.max(chosen).over(Window.partitionBy("Scenario"))
    return df.withColumn("_present", present).where(chosen | ~F.col("_present")).drop("_present")


def kpis_base_one_pass(base: DataFrame) -> DataFrame:
    """A1 from the base loans without tiers."""
    sides = (("", "", "tx"),)
    grouped = _tiered(_grouped(base, [], sides), [], sides)
    return grouped.agg(*_totals("")).select(*kpi_finish(""))


def kpis_one_pass(table: DataFrame) -> DataFrame:
    """A2, A3, A11 from ``tier_table``."""
    agg = table.groupBy("Scenario").agg(F.sum("n_loans").alias("n_loans"), *_totals("base_"), *_totals("st_"))
    return _with_deltas(agg)


def tier_histogram_one_pass(table: DataFrame) -> DataFrame:
    """A4 from ``tier_table``."""
    return _histogram(table, "base_tier", "st_tier", F.col("n_loans"))


def kpis_base(base: DataFrame) -> DataFrame:
    """A1: base KPIs over a table that already has tiers (one row)."""
    return base.agg(*kpi_aggs("EAD_12m", "PD_12m", "EL_12m", "RiskTier", "")).select(*kpi_finish(""))


def kpis_by_scenario(view: DataFrame) -> DataFrame:
    """A2, A3, A11 over a table that already has tiers (rule-based ones, say)."""
    return _with_deltas(view.groupBy("Scenario").agg(
        F.count(F.lit(1)).alias("n_loans"),
        *kpi_aggs("EAD_12m", "PD_12m", "EL_12m", "RiskTier", "base_"),
        *kpi_aggs("EAD_12m_st", "PD_12m_st", "EL_12m_st", "RiskTier_st", "st_"),
    ))


def _with_deltas(agg: DataFrame) -> DataFrame:
    """Loans in view, base and stressed KPIs and their deltas."""
    out = agg.select("Scenario", "n_loans", *kpi_finish("base_"), *kpi_finish("st_"))
    return out.select(
        "*",
        *[(F.col(f"st_{m}") - F.col(f"base_{m}")).alias(f"delta_{m}") for m in ("total_ead", "wavg_pd", "total_el", "pct_high")],
    )


def tier_histogram(view: DataFrame) -> DataFrame:
    """A4 over a table that already has tiers."""
    return _histogram(view, "RiskTier", "RiskTier_st", F.lit(1))


def _histogram(df: DataFrame, base: str, stressed: str, weight: Column) -> DataFrame:
    """Loans per tier, base and stressed, zero-filled over Low/Medium/High:
    conditional sums per scenario, unpivoted by ``stack`` without a join."""
    aggs = []
    for basis, col_name in (("base", base), ("stressed", stressed)):
        for t in TIER_ORDER:
            aggs.append(F.sum(F.when(F.col(col_name) == t, weight).otherwise(0)).cast("long").alias(f"{basis}_{t}"))
    wide = df.groupBy("Scenario").agg(*aggs)
    args = []
    for basis in ("base", "stressed"):
        for i, t in enumerate(TIER_ORDER):
            args += [F.lit(basis), F.lit(t), F.lit(i), F.col(f"{basis}_{t}")]
    return wide.select("Scenario", F.stack(F.lit(6), *args).alias("basis", "RiskTier", "tier_order", "n_loans"))


def ead_by(view: DataFrame, key: str, n: int = 10, measure: str = "EAD_12m_st") -> DataFrame:
    """Stressed EAD per key, top ``n`` per scenario (descending, ties by key)."""
    sums = view.groupBy("Scenario", key).agg(_sum0(F.col(measure)).alias("ead_st"))
    w = Window.partitionBy("Scenario").orderBy(F.col("ead_st").desc_nulls_last(), F.col(key).asc())
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top3_sector_share(view: DataFrame) -> DataFrame:
    """Share of the three largest sectors in stressed EAD, percent. The
    total is the sum over the grouped sectors, so the loans are read once."""
    sums = view.groupBy("Scenario", "Sector").agg(_sum0(F.col("EAD_12m_st")).alias("ead_st"))
    w = Window.partitionBy("Scenario").orderBy(F.col("ead_st").desc_nulls_last(), F.col("Sector").asc())
    totals = sums.withColumn("rank", F.row_number().over(w)).groupBy("Scenario").agg(
        exact_sum(F.when(F.col("rank") <= 3, F.col("ead_st"))).alias("top3_ead"), exact_sum("ead_st").alias("total_ead_st"))
    pos = F.col("total_ead_st") > 0
    return totals.select(
        "Scenario", "top3_ead", "total_ead_st",
        F.when(pos, F.col("top3_ead") / F.when(pos, F.col("total_ead_st")) * F.lit(100.0)).alias("top3_share_pct"),
    )


def badge_rollup(cov_df: DataFrame) -> DataFrame:
    """Loans per badge and percent of the view (1 decimal), largest first."""
    counts = cov_df.groupBy("Scenario", "Badge_st").agg(F.count(F.lit(1)).alias("Count"))
    w = Window.partitionBy("Scenario")
    out = counts.withColumn("Percent", np_round(F.col("Count") / F.sum("Count").over(w) * F.lit(100.0), 1))
    return out.orderBy("Scenario", F.col("Count").desc(), "Badge_st")


def lifetime_totals(life: DataFrame) -> DataFrame:
    """Lifetime EL totals (NULL loans skipped) against the summed principal."""
    agg = life.groupBy("Scenario").agg(
        _sum0(F.col("EL_life_base")).alias("el_life_base"),
        _sum0(F.col("EL_life_st")).alias("el_life_st"),
        _sum0(F.col("LoanAmount")).alias("start_ead"),
    )
    pos = F.col("start_ead") > 0
    out = agg.select(
        "Scenario", "el_life_base", "el_life_st",
        (F.col("el_life_st") - F.col("el_life_base")).alias("delta_life"),
        "start_ead",
        F.when(pos, F.col("el_life_base") / F.when(pos, F.col("start_ead")) * F.lit(100.0)).alias("pct_life_base"),
        F.when(pos, F.col("el_life_st") / F.when(pos, F.col("start_ead")) * F.lit(100.0)).alias("pct_life_st"),
    )
    return out.withColumn("delta_pct", F.col("pct_life_st") - F.col("pct_life_base"))


def portfolio_pricing(view: DataFrame, pricing: Pricing = Pricing()) -> DataFrame:
    """A10: portfolio EL rate, suggested spread (bps) and all-in rate (%)."""
    agg = view.groupBy("Scenario").agg(
        _sum0(F.col("EAD_12m_st")).alias("total_ead_st"), _sum0(F.col("EL_12m_st")).alias("total_el_st")
    )
    pos = F.col("total_ead_st") > 0
    el_rate = F.when(pos, F.col("total_el_st") / F.when(pos, F.col("total_ead_st")))
    spread_pct = (
        el_rate * F.lit(100.0) + F.lit(pricing.cap_buffer_pct) + F.lit(pricing.opex_pct) + F.lit(pricing.target_profit_pct)
    )
    return agg.select(
        "Scenario",
        el_rate.alias("el_rate"),
        (spread_pct * F.lit(100.0)).alias("spread_bps"),
        (F.lit(pricing.funding_cost_pct) + spread_pct).alias("allin_pct"),
    )
