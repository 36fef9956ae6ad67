"""The end-to-end portfolio plan: clean -> filter -> base risk -> cuts ->
scenarios -> tier view -> covenants / lifetime / pricing.

Everything up to the view is one lazy plan of projections: the scenarios
expand each loan through a generator over a literal array, and the tier cuts
enter as one scalar subquery (an aggregate over a frequency table bounded by
the number of distinct scorecard PDs).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import aggregates as agg
from ..operators.clean import clean
from ..operators.covenants import watchlist, with_covenants
from ..operators.enrich import enrich_base
from ..operators.filters import EffectiveFilters, filter_portfolio, filter_tier, require_rows
from ..operators.lifetime import with_base_lifetime_el, with_lifetime_el
from ..operators.pricing import with_pricing
from ..operators.stress import stress_risk, with_stress
from ..operators.tiers import cut_values, tier_cuts, with_base_tier, with_threshold_tier
from ..params import RunParams
from ..session import ensure_checkpoint_dir
from ..sources.layer import PortfolioLayer


@dataclass
class PortfolioRun:
    clean: DataFrame
    enriched: DataFrame  # filtered loans with base metrics
    scenarios: DataFrame  # one row per (loan, scenario) with stressed metrics, no tiers
    base: DataFrame  # filtered loans with base metrics and RiskTier
    cuts: DataFrame  # one row: n_pd, q_low, q_high
    stressed: DataFrame  # one row per (loan, scenario)
    view: DataFrame  # stressed rows after the tier filter
    filters: EffectiveFilters
    params: RunParams

    def kpis_base(self) -> DataFrame:
        """A1; one pass over the loans with percentile tiers."""
        return agg.kpis_base_one_pass(self.enriched) if self._percentile else agg.kpis_base(self.base)

    def kpis(self) -> DataFrame:
        """A2, A3, A11 over the view; one pass with percentile tiers."""
        return agg.kpis_one_pass(self._tier_table()) if self._percentile else agg.kpis_by_scenario(self.view)

    def tier_histogram(self) -> DataFrame:
        """A4 over the view; one pass with percentile tiers."""
        return agg.tier_histogram_one_pass(self._tier_table()) if self._percentile else agg.tier_histogram(self.view)

    @property
    def _percentile(self) -> bool:
        return self.params.tiering == "percentile"

    def _tier_table(self) -> DataFrame:
        return agg.tier_table(self.scenarios, self.params.tier)

    def covenants(self) -> DataFrame:
        return with_covenants(self.view, self.params.covenants)

    def lifetime(self) -> DataFrame:
        return with_lifetime_el(self.view, self.params.discount_rate)

    def watchlist(self, n: int = 10, report_rounding: bool = True) -> DataFrame:
        """V6, Red first if the run asks for ``severity_first``."""
        return watchlist(self.covenants(), n, self.params.severity_first, report_rounding)

    def pricing(self) -> DataFrame:
        return with_pricing(self.view, self.params.pricing)

    def full(self) -> DataFrame:
        """View with covenant, lifetime and pricing columns in one projection chain."""
        p = self.params
        return with_pricing(with_lifetime_el(with_covenants(self.view, p.covenants), p.discount_rate), p.pricing)


def run_portfolio(
    spark: SparkSession,
    raw: DataFrame,
    params: RunParams = RunParams(),
    check_empty: bool = False,
) -> PortfolioRun:
    cleaned = clean(raw, lenient_rates=params.lenient_rates)
    filtered, eff = filter_portfolio(cleaned, params.sector, params.geography)
    return _run(spark, cleaned, filtered, eff, params, check_empty)


def run_layer(spark: SparkSession, layer: PortfolioLayer, params: RunParams = RunParams(), check_empty: bool = False) -> PortfolioRun:
    """The same run over a stored, cleaned layer: nothing is cleaned again, and
    a sector filter reads that sector's folder only."""
    filtered, eff = layer.filtered(params.sector, params.geography)
    return _run(spark, layer.loans, filtered, eff, params, check_empty)


def _run(spark: SparkSession, cleaned: DataFrame, filtered: DataFrame, eff: EffectiveFilters, params: RunParams,
         check_empty: bool) -> PortfolioRun:
    if check_empty:
        # F5 needs a job; without it, building the run starts none.
        require_rows(filtered, params.sector, params.geography)
    enriched = enrich_base(filtered, params.dscr_row_fallback)
    if params.materialize_base:
        ensure_checkpoint_dir(spark)
        enriched = enriched.checkpoint(eager=True)
    # Cuts come from the filtered base population, before any tier filter (T9),
    # and before the scenario join, so each loan counts once.
    cuts = tier_cuts(enriched)
    q_low, q_high = cut_values(cuts)
    base = with_base_tier(enriched, q_low, q_high)
    with_life = with_base_lifetime_el(base, params.discount_rate)
    stressed = with_stress(with_life, params.scenarios, q_low, q_high, params.dscr_row_fallback)
    if params.tiering == "threshold":
        # Rule-based tiers from PD and the leverage ratios, base and stressed.
        base = _threshold_tiers(base, "")
        stressed = _threshold_tiers(_threshold_tiers(stressed, ""), "_st")
    elif params.tiering != "percentile":
        raise ValueError(f"tiering must be 'percentile' or 'threshold', got {params.tiering!r}")
    view = filter_tier(stressed, params.tier)
    scenarios = stress_risk(enriched, params.scenarios, params.dscr_row_fallback)
    return PortfolioRun(cleaned, enriched, scenarios, base, cuts, stressed, view, eff, params)


def _threshold_tiers(df: DataFrame, sfx: str) -> DataFrame:
    """Replace ``RiskTier<sfx>`` by the rule-based tier on the same metrics."""
    out = with_threshold_tier(df, sfx).drop("RiskTier" + sfx)
    return out.withColumnRenamed("RiskTier_threshold" + sfx, "RiskTier" + sfx)
