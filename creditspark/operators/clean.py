"""Cleaning (P1-P6): dimension labels, numeric coercion, rate, collateral, term, loan id.

``clean`` is one projection over the raw table: no shuffle, no UDF. Optional
columns stay absent when the input lacks them, because several rules depend on
a column's *presence* (DSCR source, the CreditScore quality rule).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import clip, collapse_ws, nan_to_null, strip_ws, to_number
from ..schema import UNKNOWN, UNKNOWN_LABELS, check_required
from ..session import ensure_checkpoint_dir
from ..sources.scan import is_file_scan

OPTIONAL_NUMERIC = ("CreditScore", "MonthlyIncome", "NOI", "EBITDA", "CollateralValue", "CurrentMarketValue")


def normalise_dim(c: Column) -> Column:
    """Strip, collapse inner whitespace, map empty / nan / none / null (any case) to Unknown.

    NULL and the unknown labels are recognised on the raw value (a blank one
    collapses to empty), so the regex runs once per row.
    """
    s = collapse_ws(strip_ws(c.cast("string")))
    unknown = c.isNull() | F.lower(strip_ws(c.cast("string"))).isin(*UNKNOWN_LABELS)
    return F.when(unknown, F.lit(UNKNOWN)).otherwise(s)


def as_number(df: DataFrame, name: str) -> Column:
    """Guarded numeric coercion (P2): strings go through ``to_number``, numbers
    are cast to double; NaN becomes NULL either way."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.StringType):
        return to_number(c)
    return nan_to_null(c.cast("double"))


def lenient_rate_text(c: Column) -> Column:
    """Accept '7.5%' and '7,5': strip blanks, drop '%', decimal comma to point."""
    s = F.regexp_replace(F.regexp_replace(strip_ws(c.cast("string")), "%", ""), ",", ".")
    return to_number(s)


def decimal_rate(r: Column) -> Column:
    """Values above 1 are percentages (P3); exactly 1.0 stays 100 %."""
    return F.when(r > 1.0, r / F.lit(100.0)).otherwise(r)


# Partitions whose counts are summed in one step of the position prefix sums.
_ID_GROUP = 1024
# A row of 16 bytes per partition is broadcast up to so many partitions.
_MOST_BROADCAST = 1 << 18


def with_generated_ids(df: DataFrame) -> DataFrame:
    """Dense ``L-001``-style ids by position (P6): rows in earlier partitions
    plus the place within the partition.

    The input is used twice, so it must not change in between: a file scan is
    read the same way again, and building the plan runs no job; anything else is
    kept first, in the shared checkpoint folder. The prefix sums over partitions
    are made in two steps, groups of partitions and partitions of a group. The
    starts, a row per partition, go to the loans by broadcast as long as the
    partitions are no more than ``_MOST_BROADCAST``, else by a join.
    """
    if not is_file_scan(df):
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    part = F.spark_partition_id()
    tagged = df.withColumn("_part", part).withColumn("_offset", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33))
    # Counted on rows without columns: only the files' row counts are read.
    counts = (df.select(part.alias("_part")).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_group", F.floor(F.col("_part") / _ID_GROUP)))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = counts.groupBy("_group").agg(F.sum("_n").alias("_n"))
    groups = groups.select("_group", earlier(Window.partitionBy(F.lit(0)).orderBy("_group")).alias("_before"))
    starts = counts.join(groups, "_group").select(
        "_part", (F.col("_before") + earlier(Window.partitionBy("_group").orderBy("_part"))).alias("_start"))
    few = df.rdd.getNumPartitions() <= _MOST_BROADCAST
    numbered = tagged.join(F.broadcast(starts) if few else starts, "_part")
    pos = numbered["_start"] + numbered["_offset"] + 1
    return numbered.withColumn("LoanID", F.format_string("L-%03d", pos)).drop("_part", "_offset", "_start")


def clean(raw: DataFrame, lenient_rates: bool = False) -> DataFrame:
    """Cleaned portfolio with canonical column names and types.

    Two projection layers: the first coerces every raw column once, the second
    derives from those named values, so no coercion expression is repeated.
    """
    check_required(raw.columns)
    cols = set(raw.columns)
    if "LoanID" not in cols:
        raw = with_generated_ids(raw)
        cols.add("LoanID")

    null_d = F.lit(None).cast("double")
    strict_rate = as_number(raw, "InterestRate")
    rate = F.coalesce(strict_rate, lenient_rate_text(F.col("InterestRate"))) if lenient_rates else strict_rate
    coerced = raw.select(
        F.coalesce(F.col("LoanID").cast("string"), F.lit("nan")).alias("LoanID"),
        (F.col("Borrower").cast("string") if "Borrower" in cols else F.lit(None).cast("string")).alias("Borrower"),
        (normalise_dim(F.col("Sector")) if "Sector" in cols else F.lit(UNKNOWN)).alias("Sector"),
        (normalise_dim(F.col("Geography")) if "Geography" in cols else F.lit(UNKNOWN)).alias("Geography"),
        as_number(raw, "LoanAmount").alias("LoanAmount"),
        rate.alias("_rate"),
        as_number(raw, "TermMonths").try_cast("int").alias("_term"),
        *[as_number(raw, n).alias(n) for n in OPTIONAL_NUMERIC if n in cols],
        (F.col("CollateralType").cast("string") if "CollateralType" in cols else F.lit(None).cast("string")).alias("CollateralType"),
        (as_number(raw, "CurrentMarketValue") if "CurrentMarketValue" in cols else null_d).alias("_cmv"),
        (as_number(raw, "CollateralValue") if "CollateralValue" in cols else null_d).alias("_cv"),
    )
    chosen = coerced.select(
        "*",
        decimal_rate(F.col("_rate")).alias("InterestRate_clean"),
        F.when(F.col("_term") > 0, F.col("_term")).alias("TermMonths"),
        F.coalesce(F.when(F.col("_cmv") > 0, F.col("_cmv")), F.when(F.col("_cv") > 0, F.col("_cv"))).alias("_coll"),
    )
    present_optional = [n for n in OPTIONAL_NUMERIC if n in cols]
    return chosen.select(
        "LoanID", "Borrower", "Sector", "Geography", "LoanAmount", "InterestRate_clean", "TermMonths",
        *present_optional, "CollateralType", clip(F.col("_coll"), 1e-9).alias("CollateralBase"),
    )


def optional(df: DataFrame, name: str) -> Column:
    """The column if the input had it, else a typed NULL."""
    return F.col(name) if name in df.columns else F.lit(None).cast("double")
