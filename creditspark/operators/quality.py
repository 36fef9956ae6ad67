"""Row data-quality rules (F7) and the issue sample (F8). Rows are reported, never dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import keep_where

# --- Fixed values that must equal the reference's for identical results -----
MSG_AMOUNT = "LoanAmount<=0 or missing"
MSG_TERM = "TermMonths<=0 or missing"
MSG_RATE = "Invalid InterestRate"
MSG_SCORE = "CreditScore out of [300,850]"
MSG_COLLATERAL = "No collateral value"
SCORE_RANGE = (300, 850)
ISSUE_SEPARATOR = ", "
# ---------------------------------------------------------------------------


def with_issues(df: DataFrame) -> DataFrame:
    """``df`` with ``Issues``: the messages of the rules that the row breaks, in
    rule order (empty if none). Each row is judged by itself, so rows that share
    a LoanID, or have none, keep their own."""
    amount, term = F.col("LoanAmount"), F.col("TermMonths")
    rate, coll = F.col("InterestRate_clean"), F.col("CollateralBase")
    rules = [
        F.when(amount.isNull() | (amount <= 0), F.lit(MSG_AMOUNT)),
        F.when(term.isNull() | (term <= 0), F.lit(MSG_TERM)),
        F.when(rate.isNull() | (rate < 0), F.lit(MSG_RATE)),
    ]
    if "CreditScore" in df.columns:
        cs = F.col("CreditScore")
        rules.append(F.when(cs.isNotNull() & ((cs < SCORE_RANGE[0]) | (cs > SCORE_RANGE[1])), F.lit(MSG_SCORE)))
    rules.append(F.when(coll.isNull() | (coll <= 0), F.lit(MSG_COLLATERAL)))
    # ``concat_ws`` skips the NULLs of rules that did not fire.
    return df.withColumn("Issues", F.concat_ws(ISSUE_SEPARATOR, *rules))


def issues(clean_df: DataFrame) -> DataFrame:
    """``(LoanID, Issues)`` for rows breaking any rule."""
    out = with_issues(clean_df).select("LoanID", "Issues")
    # Filter on the computed text without re-running the cleaning in a pushed-down predicate.
    return keep_where(out, F.col("Issues") != "")


def issue_sample(issues_df: DataFrame, n: int = 10) -> DataFrame:
    """F8: the first ``n`` issue rows by LoanID (a top-k, no full sort)."""
    return issues_df.orderBy("LoanID").limit(n)


def implausible_terms(clean_df: DataFrame, most_months: int = 1200) -> DataFrame:
    """``(LoanID, TermMonths)`` of loans beyond ``most_months`` (100 years): an
    addition to the rules above, whose messages are fixed."""
    return clean_df.where(F.col("TermMonths") > most_months).select("LoanID", "TermMonths")
