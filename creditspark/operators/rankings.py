"""Top-k rankings (K1-K4) and the ranking primitive used by the watchlist.

Per group (scenario), one pass ranks and returns whole rows. Ranking is
two-level, so that no task receives more than ``fan_in * k`` rows of a group,
however hot it is:

1. rows are ranked within (group, input partition mod ``fan_in``); Spark runs
   this ``row_number() <= k`` as a per-task group limit before the exchange, so
   each task ships at most k rows per group, with the columns that are asked for;
2. the survivors are ranked within the group.

Every global top-k row is in the top k of its own first-level slot, so the
result is exact, and partial results of any tasks merge the same way.
LoanID is the last sort key everywhere, so results do not depend on file order.
A single global top-k is ``TakeOrderedAndProject``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN_IN = 64


def rank_within(df: DataFrame, by: str, keys: list[Column], k: int, fan_in: int = FAN_IN) -> DataFrame:
    """Rows ranked 1..k per ``by`` (column ``rank``), exactly, by ``keys``
    ascending, NULLs last, then LoanID."""
    named = [c.alias(f"_key{i}") for i, c in enumerate(keys)]
    order = [F.col(f"_key{i}").asc_nulls_last() for i in range(len(keys))] + [F.col("LoanID").asc()]
    slot = F.pmod(F.spark_partition_id(), F.lit(fan_in)).alias("_slot")
    first = (df.select("*", *named, slot)
             .withColumn("_r1", F.row_number().over(Window.partitionBy(by, "_slot").orderBy(*order)))
             .where(F.col("_r1") <= k))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.drop("_slot", "_r1", *[f"_key{i}" for i in range(len(keys))])


def top_k(df: DataFrame, measure: str, k: int = 10, by: str | None = "Scenario") -> DataFrame:
    """Rows with the ``k`` largest ``measure`` (NULLs last), per ``by`` group."""
    if by is None:
        return df.orderBy(F.col(measure).desc_nulls_last(), F.col("LoanID").asc()).limit(k)
    return rank_within(df, by, [-F.col(measure)], k)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """K4: the first ``n`` loans by LoanID."""
    return df.orderBy("LoanID").limit(n)
