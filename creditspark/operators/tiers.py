"""Percentile tier cutpoints and tier assignment.

The cutpoints are exact order statistics of the base PD, taken with the
built-in ``percentile`` from a frequency table (a count per distinct PD). The
scorecard yields at most a few hundred distinct values (6 score bands x 4 DTI x
4 LTV x sector factors), so that table is small at any number of loans; PDs from
elsewhere may all differ, and take the refinement of ``quantiles`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import (
    TIER_FALLBACK,
    TIER_KEY_UNITS,
    TIER_MIN_COUNT,
    TIER_MIN_GAP,
    TIER_PERCENTILES,
    threshold_tier,
    tier_from_key,
    tier_key,
)
from .quantiles import exact_percentiles


def _cutpoints(n_pd: Column, q: Column) -> tuple[Column, Column]:
    """Low and high cut from the percentiles ``q``: a fixed fallback below 6
    values, widened about the midpoint below a 0.003 gap."""
    small = n_pd < TIER_MIN_COUNT
    lo = F.when(small, F.lit(TIER_FALLBACK[0])).otherwise(q[0])
    hi = F.when(small, F.lit(TIER_FALLBACK[1])).otherwise(q[1])
    mid, narrow = (lo + hi) / F.lit(2.0), (hi - lo) < F.lit(TIER_MIN_GAP)
    half = F.lit(TIER_MIN_GAP / 2)
    return F.when(narrow, mid - half).otherwise(lo), F.when(narrow, mid + half).otherwise(hi)


def _percentiles(x: str, n: str) -> Column:
    return F.percentile(F.col(x), list(TIER_PERCENTILES), F.col(n))


def tier_cuts(base: DataFrame, pd_col: str = "PD_12m", discrete: bool = True) -> DataFrame:
    """One row ``(n_pd, q_low, q_high)``. The frequency table is built with a
    partial count per task and merged per key, so no task merges one state per
    input partition. A NULL PD counts for nothing.

    ``discrete`` PDs are few, as the scorecard's are, and one task takes the
    percentiles of their table. Others may all differ: their percentiles are
    found by range refinement (``quantiles``), in bounded tasks."""
    # No filter on the key: it would be pushed below the scoring projections,
    # with the whole chain inlined into the predicate.
    freq = base.select(tier_key(F.col(pd_col)).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    if discrete:
        stats = freq.agg(F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("n"))), F.lit(0)).alias("n_pd"),
                         _percentiles("x", "n").alias("q"))
    else:
        units = freq.select(F.rint(F.col("x") * F.lit(TIER_KEY_UNITS)).cast("long").alias("x"), "n")
        stats = exact_percentiles(units, [], "x", "n", TIER_PERCENTILES)
        stats = stats.select(F.col("total").alias("n_pd"), F.transform("q", lambda q: q / F.lit(TIER_KEY_UNITS)).alias("q"))
    q_low, q_high = _cutpoints(F.col("n_pd"), F.col("q"))
    return stats.select(F.col("n_pd").cast("long").alias("n_pd"), q_low.alias("q_low"), q_high.alias("q_high"))


def with_window_cuts(grouped: DataFrame, by: list[str], x: str = "tx", n: str = "n_loans") -> DataFrame:
    """``grouped`` (a row per ``by`` and tier keys, with counts) with q_low and
    q_high of each ``by`` group. The groups hold the scorecard's distinct keys
    only, so a window over one of them is small."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    df = grouped.withColumn("_n", F.coalesce(F.sum(F.when(F.col(x).isNotNull(), F.col(n))).over(whole), F.lit(0)))
    df = df.withColumn("_q", _percentiles(x, n).over(whole))
    q_low, q_high = _cutpoints(F.col("_n"), F.col("_q"))
    return df.withColumn("q_low", q_low).withColumn("q_high", q_high).drop("_n", "_q")


def cut_values(cuts: DataFrame) -> tuple[Column, Column]:
    """The cutpoints as scalar subqueries. Spark runs the (merged) subquery once
    per query and inlines the two values as literals into the row stage, so the
    tiering is a plain projection; a query that does not use the tiers prunes
    the subquery, and with it the extra pass over the loans, entirely."""
    return cuts.select("q_low").scalar(), cuts.select("q_high").scalar()


def with_base_tier(df: DataFrame, q_low: Column, q_high: Column) -> DataFrame:
    df = df.withColumn("_tx", tier_key(F.col("PD_12m")))
    return df.withColumn("RiskTier", tier_from_key(F.col("_tx"), q_low, q_high)).drop("_tx")


def with_threshold_tier(df: DataFrame, suffix: str = "") -> DataFrame:
    return df.withColumn(
        "RiskTier_threshold" + suffix,
        threshold_tier(F.col("PD_12m" + suffix), F.col("LTV" + suffix), F.col("DSCR" + suffix), F.col("DTI" + suffix)),
    )
