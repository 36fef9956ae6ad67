"""The report snapshot (S7): a set of tables that is published whole (``sources.publish``)."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.publish import Published, Publisher, read_published
from . import aggregates as agg
from .covenants import watchlist
from .quality import with_issues
from .rankings import top_k
from .report import display_base_risk, display_pricing, display_stressed_risk, display_top, display_watchlist_report, mask_pii
from .stress import scenario_frame

read_snapshot = read_published


def new_snapshot_id(now: _dt.datetime | None = None) -> str:
    now = now or _dt.datetime.now(_dt.timezone.utc)
    return now.strftime("RPT-%Y%m%d-%H%M%S-") + uuid.uuid4().hex[:8]


def write_snapshot(spark: SparkSession, run, root: str, mask: bool = True, snapshot_id: str | None = None,
                   top_n: int = 10) -> Published:
    """An immutable, self-consistent report snapshot, published whole.

    The enriched view (covenants, lifetime, pricing, quality issues; masked when
    asked) is written once as the table ``loans``; every other table is then
    derived from that written copy, so all tables agree with each other even if
    executors are lost midway, and the lineage to the raw input is cut. Issues
    are a column of the row itself, so repeated and missing LoanIDs neither
    multiply rows nor share their issues. Where ids are masked, tables are ranked
    by a hash of the real id as the last key, which is kept as ``loan_key``.
    """
    sid, p = snapshot_id or new_snapshot_id(), run.params
    publisher = Publisher(spark, root, sid)

    def stage(name: str, df: DataFrame) -> DataFrame:
        return publisher.stage_table(name, df.withColumn("snapshot_id", F.lit(sid)))

    # What a filter came to is one small job, which the meta table records.
    sector, geography, _ = run.filters.resolve()
    loan = F.col("LoanID")
    full = with_issues(run.full())
    full = full.withColumn("loan_key", F.sha2(F.concat(F.lit(sid), loan), 256) if mask else loan)
    view = stage("loans", mask_pii(full) if mask else full)

    # Ranked by the real id's key, shown with the id as written.
    keyed = view.withColumnRenamed("LoanID", "shown_id").withColumnRenamed("loan_key", "LoanID")

    def shown(ranked: DataFrame) -> DataFrame:
        return ranked.drop("LoanID").withColumnRenamed("shown_id", "LoanID")

    first = p.scenarios[0].name
    one_scenario = view.where(F.col("Scenario") == first)
    tables = {
        "kpis": agg.kpis_by_scenario(view),
        "lifetime_totals": agg.lifetime_totals(view),
        "top3_sector_share": agg.top3_sector_share(view),
        "ead_by_sector": agg.ead_by(view, "Sector"),
        "ead_by_geography": agg.ead_by(view, "Geography"),
        "tier_histogram": agg.tier_histogram(view),
        "badge_rollup": agg.badge_rollup(view),
        "watchlist": display_watchlist_report(shown(watchlist(keyed, top_n, p.severity_first))),
        "top_ead": display_top(shown(top_k(keyed, "EAD_12m_st", top_n))),
        "top_el": display_top(shown(top_k(keyed, "EL_12m_st", top_n))),
        "top_spread": display_pricing(shown(top_k(keyed, "SuggestedSpread_bps", top_n)), extra=("rank",)),
        "portfolio_pricing": agg.portfolio_pricing(view, p.pricing),
        "data_quality_sample": (one_scenario.where(F.col("Issues") != "").orderBy("loan_key").limit(10)
                                .select("LoanID", "Issues")),
        "meta": spark.createDataFrame(
            [(
                _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S"),
                ",".join(s.name for s in p.scenarios),
                sector, geography, p.tier,
                float(p.discount_rate_pct), p.pricing.cap_buffer_pct, p.pricing.opex_pct,
                p.pricing.target_profit_pct, p.pricing.funding_cost_pct, bool(mask),
            )],
            "generated_utc string, scenarios string, sector string, geography string, tier string, "
            "discount_rate_pct double, cap_buffer_pct double, opex_pct double, target_profit_pct double, "
            "funding_cost_pct double, masked boolean",
        ),
        "scenarios": scenario_frame(spark, p.scenarios),
    }
    # Each of these is an aggregate or a top-k: bounded, one file.
    for name, df in tables.items():
        stage(name, df.coalesce(1))
    # The risk tables of all loans, as displayed.
    stage("base_risk", display_base_risk(one_scenario))
    stage("stressed_risk", display_stressed_risk(view))
    return publisher.publish()
