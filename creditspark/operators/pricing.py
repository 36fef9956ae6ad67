"""Risk-based pricing per loan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import Pricing


def with_pricing(df: DataFrame, pricing: Pricing = Pricing()) -> DataFrame:
    """EL_rate_st, SuggestedSpread_pct, SuggestedSpread_bps (unrounded),
    SuggestedAllInRate_pct.

    The EL rate is EL / EAD for a positive EAD.
    """
    ead = F.col("EAD_12m_st")
    df = df.withColumn("EL_rate_st", F.when(ead > 0, F.col("EL_12m_st") / F.when(ead > 0, ead)))
    df = df.withColumn("SuggestedSpread_pct", F.col("EL_rate_st") + F.lit(pricing.add_ons))
    return df.select(
        "*",
        (F.col("SuggestedSpread_pct") * F.lit(10000.0)).alias("SuggestedSpread_bps"),
        ((F.lit(pricing.funding_cost_pct / 100.0) + F.col("SuggestedSpread_pct")) * F.lit(100.0)).alias(
            "SuggestedAllInRate_pct"
        ),
    )
