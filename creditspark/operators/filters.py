"""Sector / geography / tier filters with the reference's relaxation rules.

Relaxation needs to know whether a filter leaves anything. That is one narrow
aggregate over the cleaned labels, a scalar subquery of the plan: building the
plan runs no job. Labels are normalised once, in their own layer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import keep_where
from ..schema import EmptyPortfolioError

ALL = "All"
TIERS = ("Low", "Medium", "High")


@dataclass(frozen=True)
class EffectiveFilters:
    """The requested filters, and what presence the plan sees (a DataFrame of
    one row: has_both, has_sector); None if nothing is filtered."""

    asked_sector: str
    asked_geography: str
    presence: DataFrame | None = None

    def _flag(self, name: str) -> Column:
        return F.coalesce(self.presence.select(name).scalar(), F.lit(False))

    @property
    def sector_column(self) -> Column:
        """The sector filter in effect, known when the plan runs."""
        if self.asked_sector == ALL or self.asked_geography != ALL or self.presence is None:
            return F.lit(self.asked_sector)  # the geography is relaxed first
        return F.when(self._flag("has_sector"), F.lit(self.asked_sector)).otherwise(F.lit(ALL))

    @property
    def geography_column(self) -> Column:
        if self.asked_geography == ALL or self.presence is None:
            return F.lit(self.asked_geography)
        return F.when(self._flag("has_both"), F.lit(self.asked_geography)).otherwise(F.lit(ALL))

    def resolve(self) -> tuple[str, str, tuple[tuple[str, str], ...]]:
        """(sector, geography, dropped filters as (dimension, value)); runs the
        narrow aggregate."""
        if self.presence is None:
            return self.asked_sector, self.asked_geography, ()
        has = self.presence.head()
        if self.asked_geography != ALL:
            if has["has_both"]:
                return self.asked_sector, self.asked_geography, ()
            return self.asked_sector, ALL, (("geography", self.asked_geography),)
        if has["has_sector"]:
            return self.asked_sector, ALL, ()
        return ALL, ALL, (("sector", self.asked_sector),)


def filter_portfolio(df: DataFrame, sector: str = ALL, geography: str = ALL) -> tuple[DataFrame, EffectiveFilters]:
    """Filter; if nothing is left, first drop the geography, else the sector."""
    if sector == ALL and geography == ALL:
        return df, EffectiveFilters(sector, geography)
    in_sector = F.lit(True) if sector == ALL else F.col("Sector") == sector
    in_geography = F.lit(True) if geography == ALL else F.col("Geography") == geography
    presence = df.agg(F.coalesce(F.max(in_sector & in_geography), F.lit(False)).alias("has_both"),
                      F.coalesce(F.max(in_sector), F.lit(False)).alias("has_sector"))
    eff = EffectiveFilters(sector, geography, presence)
    kept = (eff.sector_column.eqNullSafe(F.lit(ALL)) | in_sector) & (eff.geography_column.eqNullSafe(F.lit(ALL)) | in_geography)
    # In place, on the named labels: a pushed-down predicate would carry the
    # label's whole expression into the join conditions below.
    return keep_where(df, kept), eff


def require_rows(df: DataFrame, sector: str = ALL, geography: str = ALL) -> DataFrame:
    """stop when no loans remain (a job that ends at the first row)."""
    if df.isEmpty():
        raise EmptyPortfolioError(sector, geography)
    return df


def filter_tier(stressed: DataFrame, tier: str = ALL) -> DataFrame:
    """keep one stressed tier, per scenario; a scenario in which that tier
    does not occur keeps all its loans. Which scenarios have it is one value of
    the plan, a map with an entry per scenario, so the loans themselves are
    filtered where they are, without an exchange. (KPIs take
    ``aggregates.tier_table``, in one pass.)"""
    if tier == ALL:
        return stressed
    if tier not in TIERS:
        raise ValueError(f"tier must be one of {TIERS} or 'All', got {tier!r}")
    chosen = F.col("RiskTier_st") == tier
    present = stressed.groupBy("Scenario").agg(F.max(chosen).alias("has"))
    present = present.agg(F.map_from_entries(F.collect_list(F.struct("Scenario", "has"))).alias("has")).scalar()
    # In place: a pushed-down predicate would carry the whole scoring with it.
    return keep_where(stressed, ~F.coalesce(present[F.col("Scenario")], F.lit(False)) | chosen)


def filter_domains(df: DataFrame) -> DataFrame:
    """sorted distinct values of each filter dimension, as (dimension, value).

    Distinct runs as a partial aggregate per task, so only distinct labels move.
    """
    dims = df.select(F.stack(F.lit(2), F.lit("Sector"), F.col("Sector"), F.lit("Geography"), F.col("Geography")).alias("dimension", "value"))
    return dims.distinct().orderBy("dimension", "value")
