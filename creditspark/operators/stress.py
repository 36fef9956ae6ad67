"""Macro stress scenarios.

All scenarios run in one pass. The scenarios are parameters, so each loan row
is expanded into one row per scenario by ``inline`` over a literal array of
scenario structs: a generator inside the same stage, with no join, no
broadcast and no shuffle of loans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cashflow import cashflow_layers, stressed_collateral, stressed_rate
from ..functions.core import apply_layers, drop_helpers, safe_div
from ..functions.scoring import ead_12m, lgd, pd_scorecard, stressed_pd, tier_from_key, tier_key
from ..params import Scenario
from .clean import optional
from .enrich import dscr_expr

SCENARIO_SCHEMA = "Scenario string, scenario_order int, rate_bps double, unemp_pp double, coll_drop double, unemp_mult double"


def scenario_frame(spark: SparkSession, scenarios: Sequence[Scenario]) -> DataFrame:
    """The scenario table (X1) for display and reporting."""
    _check(scenarios)
    # A VALUES list is a local relation: broadcasting it needs no Spark job.
    def q(text: str) -> str:
        return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def d(x) -> str:
        return f"{float(x)!r}D"

    rows = ", ".join(
        f"({q(s.name)}, {i}, {d(s.rate_bps)}, {d(s.unemp_pp)}, {d(s.coll_drop)}, {d(s.unemp_mult)})"
        for i, s in enumerate(scenarios)
    )
    cols = ", ".join(f.split()[0] for f in SCENARIO_SCHEMA.split(", "))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({cols})")


def _check(scenarios: Sequence[Scenario]) -> None:
    if not scenarios:
        raise ValueError("at least one scenario is needed")
    names = [s.name for s in scenarios]
    if len(set(names)) != len(names):
        raise ValueError(f"scenario names must be unique: {names}")


def scenario_array(scenarios: Sequence[Scenario]) -> Column:
    """The scenarios as a literal array of structs (folded into the plan)."""
    _check(scenarios)
    return F.array(*[
        F.struct(
            F.lit(s.name).alias("Scenario"), F.lit(i).alias("scenario_order"),
            F.lit(float(s.rate_bps)).alias("rate_bps"), F.lit(float(s.unemp_pp)).alias("unemp_pp"),
            F.lit(float(s.coll_drop)).alias("coll_drop"), F.lit(float(s.unemp_mult)).alias("unemp_mult"),
        )
        for i, s in enumerate(scenarios)
    ])


def stress_risk(base: DataFrame, scenarios: Sequence[Scenario], dscr_row_fallback: bool = False) -> DataFrame:
    """Stressed cash flows, ratios, PD / LGD / EAD / EL for every (loan,
    scenario). Expects the base columns (with ``_base_pd``, ``_sector_f``,
    ``_haircut``)."""
    df = base.select("*", F.inline(scenario_array(scenarios)))
    P = F.col("LoanAmount")
    df = df.select(
        "*",
        stressed_rate(F.col("InterestRate_clean"), F.col("rate_bps")).alias("InterestRate_st"),
        stressed_collateral(F.col("CollateralBase"), F.col("coll_drop")).alias("CollateralBase_st"),
    )
    df = apply_layers(df, cashflow_layers("InterestRate_st", "_st"))
    df = df.select(
        "*",
        (P / F.col("CollateralBase_st")).alias("LTV_st"),
        safe_div(F.col("MonthlyPayment_st"), optional(df, "MonthlyIncome")).alias("DTI_st"),
        dscr_expr(df, F.col("AnnualDebtService_st"), dscr_row_fallback).alias("DSCR_st"),
        safe_div(optional(df, "EBITDA"), F.col("Interest_Y1_st")).alias("ICR_st"),
    )
    df = df.select(
        "*",
        pd_scorecard(None, F.col("DTI_st"), F.col("LTV_st"), sector_f="_sector_f", base_pd="_base_pd").alias(
            "PD_12m_st_preU"
        ),
        lgd(P, F.col("CollateralBase_st"), haircut_col="_haircut").alias("LGD_st"),
        ead_12m(P, F.col("Balance_12m_st")).alias("EAD_12m_st"),
    )
    df = df.withColumn("PD_12m_st", stressed_pd(F.col("PD_12m_st_preU"), F.col("unemp_mult")))
    return drop_helpers(df.withColumn("EL_12m_st", F.col("PD_12m_st") * F.col("LGD_st") * F.col("EAD_12m_st")))


def with_stress(base: DataFrame, scenarios: Sequence[Scenario], q_low: Column, q_high: Column,
                dscr_row_fallback: bool = False) -> DataFrame:
    """``stress_risk`` with RiskTier_st: stressed tiers use the *base* cutpoints."""
    df = stress_risk(base, scenarios, dscr_row_fallback).withColumn("_tx_st", tier_key(F.col("PD_12m_st")))
    return drop_helpers(df.withColumn("RiskTier_st", tier_from_key(F.col("_tx_st"), q_low, q_high)))
