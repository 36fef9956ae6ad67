"""Base cash flows, ratios and risk (C1-C8, R1-R4) as named projection layers.

Each layer names what the next one reuses (rate, growth factors, payment), so
every ``pow`` and lookup is evaluated once per row and the generated code stays
small. Helper columns start with an underscore; ``_base_pd``, ``_sector_f``
and ``_haircut`` are kept because the stress operator reuses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cashflow import cashflow_layers
from ..functions.core import apply_layers, key_of, lookup, safe_div
from ..functions.scoring import (
    HAIRCUT_DEFAULT, HAIRCUTS, SECTOR_DEFAULT, SECTOR_FACTORS, ead_12m, lgd, pd_scorecard, score_base_pd,
)
from .clean import optional

KEEP_FOR_STRESS = ("_base_pd", "_sector_f", "_haircut")


def dscr_expr(df: DataFrame, ads: Column, row_fallback: bool = False) -> Column:
    """DSCR source is chosen per *table*: NOI if the column exists (even when
    empty), else income x 12. ``row_fallback`` takes income where NOI is NULL."""
    income12 = optional(df, "MonthlyIncome") * F.lit(12.0)
    if "NOI" in df.columns:
        num = F.coalesce(F.col("NOI"), income12) if row_fallback else F.col("NOI")
    else:
        num = income12
    return safe_div(num, ads)


def with_cashflows(df: DataFrame) -> DataFrame:
    """MonthlyPayment, AnnualDebtService, Balance_12m, Interest_Y1."""
    return apply_layers(df, cashflow_layers("InterestRate_clean"))


def with_ratios(df: DataFrame, dscr_row_fallback: bool = False) -> DataFrame:
    """LTV, DTI, DSCR, ICR."""
    return df.select(
        "*",
        safe_div(F.col("LoanAmount"), F.col("CollateralBase")).alias("LTV"),
        safe_div(F.col("MonthlyPayment"), optional(df, "MonthlyIncome")).alias("DTI"),
        dscr_expr(df, F.col("AnnualDebtService"), dscr_row_fallback).alias("DSCR"),
        safe_div(optional(df, "EBITDA"), F.col("Interest_Y1")).alias("ICR"),
    )


def with_risk(df: DataFrame) -> DataFrame:
    """PD_12m, LGD, EAD_12m, EL_12m."""
    df = df.select(
        "*",
        score_base_pd(optional(df, "CreditScore")).alias("_base_pd"),
        # Sector is already stripped by cleaning; the key is its lower case.
        lookup(F.lower(F.col("Sector")), SECTOR_FACTORS, SECTOR_DEFAULT).alias("_sector_f"),
        lookup(key_of(F.col("CollateralType")), HAIRCUTS, HAIRCUT_DEFAULT).alias("_haircut"),
    )
    df = df.select(
        "*",
        pd_scorecard(None, F.col("DTI"), F.col("LTV"), sector_f="_sector_f", base_pd="_base_pd").alias("PD_12m"),
        lgd(F.col("LoanAmount"), F.col("CollateralBase"), haircut_col="_haircut").alias("LGD"),
        ead_12m(F.col("LoanAmount"), F.col("Balance_12m")).alias("EAD_12m"),
    )
    return df.withColumn("EL_12m", F.col("PD_12m") * F.col("LGD") * F.col("EAD_12m"))


def enrich_base(clean_df: DataFrame, dscr_row_fallback: bool = False) -> DataFrame:
    out = with_risk(with_ratios(with_cashflows(clean_df), dscr_row_fallback))
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in KEEP_FOR_STRESS])
