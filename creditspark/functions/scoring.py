"""Scorecard PD, collateral LGD, 12-month EAD, tiering (R1-R7) as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import PD_ST_CAP, PD_ST_FLOOR
from .core import clip, col, key_of, lit, lookup

# --- Fixed values that must equal the reference's for identical results -----
# Credit-score bands (score >= bound -> base PD), checked top down; missing score 0.03.
SCORE_BANDS = ((760, 0.005), (720, 0.008), (680, 0.015), (640, 0.030), (600, 0.060))
SCORE_FLOOR_PD, SCORE_MISSING_PD = 0.100, 0.03
# DTI bands (dti <= bound -> factor), else 2.2; missing 1.2.
DTI_BANDS = ((0.20, 1.0), (0.35, 1.2), (0.50, 1.6))
DTI_ABOVE, DTI_MISSING = 2.2, 1.2
# LTV bands (ltv <= bound -> factor), else 2.0; missing 1.2.
LTV_BANDS = ((0.70, 1.0), (0.85, 1.2), (1.00, 1.5))
LTV_ABOVE, LTV_MISSING = 2.0, 1.2
# Sector PD factors, keyed by stripped lower-case sector; others 1.0.
SECTOR_FACTORS = {
    "construction": 1.30, "retail": 1.25, "realestate": 1.20, "real estate": 1.20,
    "hospitality": 1.25, "manufacturing": 1.10, "healthcare": 1.10, "transport": 1.15,
}
SECTOR_DEFAULT = 1.0
# Base PD bounds.
PD_FLOOR, PD_CAP = 0.002, 0.35
# Collateral haircuts, keyed by stripped lower-case type; others (and missing) 0.50.
HAIRCUTS = {
    "realestate": 0.30, "real estate": 0.30, "equipment": 0.45, "inventory": 0.60,
    "ar": 0.60, "accounts receivable": 0.60, "securities": 0.10,
}
HAIRCUT_DEFAULT = 0.50
RECOVERY_COST = 0.10
LGD_NO_COLLATERAL, LGD_FLOOR, LGD_CAP = 0.60, 0.05, 0.95
# Tiering: PD floor before cutting, fallback cuts below 6 values, minimum gap.
TIER_PD_FLOOR, TIER_MIN_COUNT, TIER_FALLBACK, TIER_MIN_GAP = 1e-5, 6, (0.02, 0.06), 0.003
TIER_PERCENTILES = (0.33, 0.66)
# Legacy threshold tiering: High / Medium triggers (pd >=, ltv >, dscr <, dti >).
THRESHOLD_HIGH = (0.06, 0.90, 1.20, 0.45)
THRESHOLD_MEDIUM = (0.02, 0.80, 1.50, 0.35)
# ---------------------------------------------------------------------------


def _ge_bands(x: Column, bands, below, missing) -> Column:
    out = F.when(x.isNull(), F.lit(missing))
    for bound, value in bands:
        out = out.when(x >= bound, F.lit(value))
    return out.otherwise(F.lit(below))


def _le_bands(x: Column, bands, above, missing) -> Column:
    out = F.when(x.isNull(), F.lit(missing))
    for bound, value in bands:
        out = out.when(x <= bound, F.lit(value))
    return out.otherwise(F.lit(above))


def sector_factor(sector) -> Column:
    return lookup(key_of(sector), SECTOR_FACTORS, SECTOR_DEFAULT)


def score_base_pd(credit_score) -> Column:
    return _ge_bands(col(credit_score), SCORE_BANDS, SCORE_FLOOR_PD, SCORE_MISSING_PD)


def pd_raw(credit_score, dti, ltv, sector=None, sector_f=None, base_pd=None) -> Column:
    """Scorecard product before clipping: base x DTI factor x LTV factor x sector.

    ``sector_f`` / ``base_pd`` may pass precomputed columns (they do not change
    under stress, so a scenario run computes them once per loan)."""
    base = score_base_pd(credit_score) if base_pd is None else col(base_pd)
    dti_f = _le_bands(col(dti), DTI_BANDS, DTI_ABOVE, DTI_MISSING)
    ltv_f = _le_bands(col(ltv), LTV_BANDS, LTV_ABOVE, LTV_MISSING)
    sf = sector_factor(sector) if sector_f is None else col(sector_f)
    return base * dti_f * ltv_f * sf


def pd_scorecard(credit_score, dti, ltv, sector=None, sector_f=None, base_pd=None) -> Column:
    """12-month PD in [0.002, 0.35]."""
    raw = pd_raw(credit_score, dti, ltv, sector, sector_f, base_pd)
    return F.least(F.greatest(raw, F.lit(PD_FLOOR)), F.lit(PD_CAP))


def stressed_pd(pd_pre_unemp, unemp_mult) -> Column:
    """Unemployment multiplier and the wider stressed bounds."""
    return clip(col(pd_pre_unemp) * lit(unemp_mult), PD_ST_FLOOR, PD_ST_CAP)


def haircut(coll_type) -> Column:
    return lookup(key_of(coll_type), HAIRCUTS, HAIRCUT_DEFAULT)


def lgd(loan_amount, collateral_base, coll_type=None, haircut_col=None) -> Column:
    """Collateral LGD (R2): 0.60 without usable amount or collateral, else
    ``1 - min(C(1-h)/P, 1) * 0.9`` clipped to [0.05, 0.95]."""
    P, C = col(loan_amount), col(collateral_base)
    h = haircut(coll_type) if haircut_col is None else col(haircut_col)
    effective = F.greatest(C, F.lit(0.0)) * (F.lit(1.0) - h)
    recovery = F.least(effective / P, F.lit(1.0)) * (F.lit(1.0) - F.lit(RECOVERY_COST))
    bounded = F.least(F.greatest(F.lit(1.0) - recovery, F.lit(LGD_FLOOR)), F.lit(LGD_CAP))
    no_cover = P.isNull() | (P <= 0) | C.isNull() | (C <= 0)
    return F.when(no_cover, F.lit(LGD_NO_COLLATERAL)).otherwise(bounded)


def ead_12m(loan_amount, balance_12m) -> Column:
    """Average exposure over the first year."""
    P, B = col(loan_amount), col(balance_12m)
    return (
        F.when(P.isNull(), F.lit(None).cast("double"))
        .when(B.isNull(), P)
        .otherwise(F.lit(0.5) * (P + F.greatest(F.lit(0.0), B)))
    )


# Units of the tier key in 1.
TIER_KEY_UNITS = 1e12


def tier_key(pd_col) -> Column:
    """PD as used for cutting and comparing: floored at 1e-5 and rounded to
    12 decimals, so that factor-order ulps cannot split ties."""
    x = clip(pd_col, TIER_PD_FLOOR)
    return F.rint(x * F.lit(TIER_KEY_UNITS)) / F.lit(TIER_KEY_UNITS)


def tier_from_cuts(pd_col, q_low, q_high) -> Column:
    """Low / Medium / High against the cutpoints; missing PD is Medium."""
    return tier_from_key(tier_key(pd_col), q_low, q_high)


def tier_from_key(x, q_low, q_high) -> Column:
    """As ``tier_from_cuts`` on an already computed ``tier_key`` column."""
    x = col(x)
    return (
        F.when(x <= lit(q_low), F.lit("Low"))
        .when(x <= lit(q_high), F.lit("Medium"))
        .when(x > lit(q_high), F.lit("High"))
        .otherwise(F.lit("Medium"))
    )


def threshold_tier(pd12, ltv, dscr, dti) -> Column:
    """Legacy rule-based tier (R7); a missing input never triggers."""
    pd12, ltv, dscr, dti = col(pd12), col(ltv), col(dscr), col(dti)

    def hit(limits):
        p, l, s, d = limits
        no = F.lit(False)
        return (
            F.coalesce(pd12 >= p, no)
            | F.coalesce(ltv > l, no)
            | F.coalesce(dscr < s, no)
            | F.coalesce(dti > d, no)
        )

    return F.when(hit(THRESHOLD_HIGH), F.lit("High")).when(hit(THRESHOLD_MEDIUM), F.lit("Medium")).otherwise(F.lit("Low"))
