"""Covenant headroom, badge, worst headroom and tightest covenant (V2-V5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import Covenants
from .core import col

COVENANT_NAMES = ("DSCR", "ICR", "LTV", "DTI")


def headrooms(dscr, icr, ltv, dti, cov: Covenants) -> dict[str, Column]:
    """Distance to each limit; positive is inside the covenant."""
    return {
        "HR_DSCR_st": col(dscr) - F.lit(cov.dscr_min),
        "HR_ICR_st": col(icr) - F.lit(cov.icr_min),
        "HR_LTV_st": F.lit(cov.ltv_max) - col(ltv),
        "HR_DTI_st": F.lit(cov.dti_max) - col(dti),
    }


def badge(dscr, icr, ltv, dti, cov: Covenants) -> Column:
    """Red on any breach, Amber inside any amber band, else Green.

    A NULL metric never breaches: each comparison is coalesced to false.
    """
    dscr, icr, ltv, dti = col(dscr), col(icr), col(ltv), col(dti)
    no = F.lit(False)

    def any_of(d_lim, i_lim, l_lim, t_lim):
        return (
            F.coalesce(dscr < d_lim, no)
            | F.coalesce(icr < i_lim, no)
            | F.coalesce(ltv > l_lim, no)
            | F.coalesce(dti > t_lim, no)
        )

    red = any_of(cov.dscr_min, cov.icr_min, cov.ltv_max, cov.dti_max)
    amber = any_of(cov.dscr_amber, cov.icr_amber, cov.ltv_amber, cov.dti_amber)
    return F.when(red, F.lit("Red")).when(amber, F.lit("Amber")).otherwise(F.lit("Green"))


def worst_headroom(hr: dict[str, Column]) -> Column:
    """Minimum of the present headrooms (``least`` skips NULLs)."""
    return F.least(*hr.values())


def tightest(hr: dict[str, Column], worst: Column) -> Column:
    """Name of the covenant with the smallest headroom; first in
    DSCR, ICR, LTV, DTI order wins ties; NULL when all are NULL."""
    out = None
    for name, c in zip(COVENANT_NAMES, hr.values()):
        cond = c == worst
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out
