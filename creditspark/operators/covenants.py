"""Covenant table, watchlist and exceptions (V1-V7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import keep_where, np_round
from ..functions.covenant import badge, headrooms, tightest, worst_headroom
from ..params import Covenants
from .rankings import rank_within

WATCH_BADGES = ("Red", "Amber")


def with_covenants(stressed: DataFrame, cov: Covenants = Covenants()) -> DataFrame:
    """Headrooms, Badge_st, WorstHeadroom_st, Tightest on the stressed metrics."""
    hr = headrooms(F.col("DSCR_st"), F.col("ICR_st"), F.col("LTV_st"), F.col("DTI_st"), cov)
    df = stressed.select(
        "*",
        *[c.alias(name) for name, c in hr.items()],
        badge(F.col("DSCR_st"), F.col("ICR_st"), F.col("LTV_st"), F.col("DTI_st"), cov).alias("Badge_st"),
    )
    named = {name: F.col(name) for name in hr}
    df = df.withColumn("WorstHeadroom_st", worst_headroom(named))
    return df.withColumn("Tightest", tightest(named, F.col("WorstHeadroom_st")))


def exceptions(cov_df: DataFrame) -> DataFrame:
    """V7: every Red / Amber loan (feeds the exceptions sink)."""
    cols = ["Scenario", "LoanID", "Borrower", "Sector", "Geography", "DSCR_st", "ICR_st", "LTV_st", "DTI_st",
            "Badge_st", "WorstHeadroom_st"]
    return keep_where(cov_df, F.col("Badge_st").isin(*WATCH_BADGES)).select(*cols)


def watchlist(cov_df: DataFrame, n: int = 10, severity_first: bool = False, report_rounding: bool = True) -> DataFrame:
    """V6: top ``n`` Red / Amber loans per scenario.

    Reference order sorts the badge *alphabetically* (Amber before Red), then
    worst headroom ascending; ``severity_first`` puts Red first. The report
    rounds to 4 decimals before sorting, which the default follows. LoanID
    breaks remaining ties. Only Red and Amber rows are ranked, on narrow keys.
    """
    # Without the report's rounding, values that differ in their last bits only
    # (equal terms and rates at other amounts) still count as ties.
    worst = np_round(F.col("WorstHeadroom_st"), 4 if report_rounding else 10)
    badge_key = F.when(F.col("Badge_st") == "Red", 0).otherwise(1) if severity_first else F.col("Badge_st")
    watched = keep_where(cov_df, F.col("Badge_st").isin(*WATCH_BADGES))
    return rank_within(watched, "Scenario", [badge_key, worst], n)
