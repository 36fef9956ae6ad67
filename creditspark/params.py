"""Run parameters: scenarios, covenant limits, pricing add-ons, discount rate.

Every parameter reaches the plan as a literal (scenarios as an array of literal
structs), so Catalyst folds it into the generated code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- Fixed values that must equal the reference's for identical results -----
# Scenario presets: name, rate shock (bps), unemployment shock (pp), collateral drop (%).
PRESETS = (
    ("Base", 0, 0, 0),
    ("Adverse", 100, 2, 10),
    ("Severe", 250, 5, 25),
)
# Custom-scenario slider ranges: bps -300..300, pp 0..10, drop 0..60.
CUSTOM_LIMITS = {"rate_bps": (-300, 300), "unemp_pp": (0, 10), "coll_drop": (0, 60)}
# Covenant defaults and amber margins.
DSCR_MIN, ICR_MIN, LTV_MAX, DTI_MAX = 1.20, 2.00, 0.85, 0.45
DSCR_AMBER_ADD, ICR_AMBER_ADD, LTV_AMBER_SUB, DTI_AMBER_SUB = 0.15, 0.25, 0.05, 0.05
# Pricing defaults (percent).
CAP_BUFFER_PCT, OPEX_PCT, TARGET_PROFIT_PCT, FUNDING_COST_PCT = 1.00, 0.50, 0.50, 3.00
# Lifetime EL discount rate (annual percent).
DISCOUNT_RATE_PCT = 6.00
# Unemployment PD multiplier: 1 + 0.10 * pp, capped at 2.5.
UNEMP_SLOPE, UNEMP_CAP = 0.10, 2.5
# Stressed PD bounds.
PD_ST_FLOOR, PD_ST_CAP = 0.002, 0.60
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Scenario:
    name: str
    rate_bps: float = 0
    unemp_pp: float = 0
    coll_drop: float = 0

    @property
    def unemp_mult(self) -> float:
        return min(1.0 + UNEMP_SLOPE * float(self.unemp_pp), UNEMP_CAP)


def preset_scenarios(names=("Base", "Adverse", "Severe")) -> tuple[Scenario, ...]:
    table = {p[0]: Scenario(*p) for p in PRESETS}
    return tuple(table[n] for n in names)


def custom_scenario(rate_bps=0, unemp_pp=0, coll_drop=0, name="Custom", strict=False) -> Scenario:
    """A user scenario; ``strict`` enforces the dashboard's slider ranges."""
    if strict:
        for key, val in (("rate_bps", rate_bps), ("unemp_pp", unemp_pp), ("coll_drop", coll_drop)):
            lo, hi = CUSTOM_LIMITS[key]
            if not lo <= val <= hi:
                raise ValueError(f"{key}={val} outside [{lo}, {hi}]")
    return Scenario(name, rate_bps, unemp_pp, coll_drop)


@dataclass(frozen=True)
class Covenants:
    dscr_min: float = DSCR_MIN
    icr_min: float = ICR_MIN
    ltv_max: float = LTV_MAX
    dti_max: float = DTI_MAX

    # Amber limits are derived exactly as plain float arithmetic, so that
    # e.g. 0.85 - 0.05 keeps its binary value 0.7999999999999999.
    @property
    def dscr_amber(self) -> float:
        return self.dscr_min + DSCR_AMBER_ADD

    @property
    def icr_amber(self) -> float:
        return self.icr_min + ICR_AMBER_ADD

    @property
    def ltv_amber(self) -> float:
        return max(0.0, self.ltv_max - LTV_AMBER_SUB)

    @property
    def dti_amber(self) -> float:
        return max(0.0, self.dti_max - DTI_AMBER_SUB)


@dataclass(frozen=True)
class Pricing:
    cap_buffer_pct: float = CAP_BUFFER_PCT
    opex_pct: float = OPEX_PCT
    target_profit_pct: float = TARGET_PROFIT_PCT
    funding_cost_pct: float = FUNDING_COST_PCT

    @property
    def add_ons(self) -> float:
        return (self.cap_buffer_pct + self.opex_pct + self.target_profit_pct) / 100.0


@dataclass(frozen=True)
class RunParams:
    """Everything a portfolio run needs besides the data."""

    scenarios: tuple[Scenario, ...] = field(default_factory=preset_scenarios)
    covenants: Covenants = field(default_factory=Covenants)
    pricing: Pricing = field(default_factory=Pricing)
    discount_rate_pct: float = DISCOUNT_RATE_PCT
    sector: str = "All"
    geography: str = "All"
    tier: str = "All"
    # Options that switch reference quirks off (see README, "Deviations").
    dscr_row_fallback: bool = False
    lenient_rates: bool = False
    severity_first: bool = False
    # "percentile" (33/66 cuts on base PD, the default) or "threshold" (R7 rules).
    tiering: str = "percentile"
    # Write the cleaned, enriched base once (reliable checkpoint in the shared
    # spark.checkpoint.dir) so that the cut pass and every later analysis read
    # it instead of re-running the source scan and joins.
    materialize_base: bool = False

    @property
    def discount_rate(self) -> float:
        return float(self.discount_rate_pct) / 100.0
