"""Lifetime expected loss per loan (L4) and the amortisation schedule (L2)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cashflow import ZERO_RATE_EPS, monthly_rate
from ..functions.core import apply_layers, clip, keep_where
from ..functions.lifetime import BALANCE_STOP, lifetime_el_layers, monthly_discount, monthly_hazard
from ..functions.sums import exact_sum


# Months of a loan are generated in blocks of blocks of so many.
BLOCK = 1024


def with_base_lifetime_el(df: DataFrame, discount_rate: float) -> DataFrame:
    """EL_life_base (base rate, PD, LGD). It does not depend on the scenario, so
    a run adds it to the loans before they are expanded; queries that do not ask
    for it prune it."""
    out = apply_layers(df, lifetime_el_layers("LoanAmount", "InterestRate_clean", "TermMonths", "PD_12m", "LGD", discount_rate,
                                              "EL_life_base", "lb"))
    return out.drop(*[c for c in out.columns if c.startswith("_lb_")])


def with_lifetime_el(df: DataFrame, discount_rate: float) -> DataFrame:
    """EL_life_base (unless it is there) and EL_life_st (stressed rate, PD, LGD), as
    closed forms: a handful of projection layers, no explode, no shuffle."""
    if "EL_life_base" not in df.columns:
        df = with_base_lifetime_el(df, discount_rate)
    out = apply_layers(df, lifetime_el_layers("LoanAmount", "InterestRate_st", "TermMonths", "PD_12m_st", "LGD_st",
                                              discount_rate, "EL_life_st", "ls"))
    return out.drop(*[c for c in out.columns if c.startswith("_ls_")])


def amortisation_schedule(df: DataFrame, discount_rate: float, stressed: bool = True) -> DataFrame:
    """One row per loan and month (L2): opening balance, interest, principal,
    survival, default mass, loss and discounted loss.

    Generated with closed-form balances inside the task that holds the loan (no
    shuffle), in nested blocks of months, so no array grows with the term; the
    output is ~term x the input, written or aggregated downstream. Months after
    the balance is exhausted are dropped, as in the month loop. A loan without a
    payment (its growth factor overflows) has no schedule;
    ``quality.implausible_terms`` reports such terms.
    """
    sfx = "_st" if stressed else ""
    rate_col = "InterestRate_st" if stressed else "InterestRate_clean"
    P, R, n = F.col("LoanAmount"), F.col(rate_col), F.col("TermMonths")
    A = F.col("MonthlyPayment" + sfx)
    pd_col, lgd_col = F.col(("PD_12m_st" if stressed else "PD_12m")), F.col("LGD" + sfx)
    # Plain tests on cleaned columns: they reach the scan side.
    df = df.where(P.isNotNull() & F.col("InterestRate_clean").isNotNull() & n.isNotNull())
    keys = [c for c in ("Scenario",) if c in df.columns]
    d = monthly_discount(discount_rate)
    r = monthly_rate(R)
    # Per-loan logarithms, so that each month needs exp() of a product instead
    # of pow() (Spark evaluates both with StrictMath; exp is the cheaper one).
    per_loan = df.select(
        *keys, "LoanID", P.alias("_prin"), r.alias("_r"), n.alias("_n"), A.alias("_A"),
        monthly_hazard(pd_col).alias("_haz"), clip(lgd_col, 0.0, 1.0).alias("_lgd"),
    )
    # Everything beside the generator in this projection is evaluated once per loan.
    known = F.col("_A").isNotNull() & F.col("_haz").isNotNull() & F.col("_lgd").isNotNull()
    blocks = F.sequence(F.lit(0), ((F.col("_n") - 1) / (BLOCK * BLOCK)).cast("int"))
    rows = per_loan.select(
        "*", F.log1p(F.col("_r")).alias("_lg"), F.log1p(-F.col("_haz")).alias("_ls"),
        F.explode(F.when(known, blocks)).alias("_outer"),
    )
    last = ((F.col("_n") - 1) / BLOCK).cast("int")
    first = F.col("_outer") * BLOCK
    rows = rows.select("*", F.explode(F.sequence(first, F.least(first + (BLOCK - 1), last))).alias("_inner"))
    first = F.col("_inner") * BLOCK
    rows = rows.select("*", F.explode(F.sequence(first + 1, F.least(first + BLOCK, F.col("_n")))).alias("month"))
    rows = rows.withColumn("_j", (F.col("month") - 1).cast("double"))
    zero = F.abs(F.col("_r")) < ZERO_RATE_EPS
    g = F.exp(F.col("_j") * F.col("_lg"))
    open_bal = F.when(zero, F.col("_prin") - (F.col("_prin") / F.col("_n")) * F.col("_j")).otherwise(
        F.col("_prin") * g - F.col("_A") * (g - F.lit(1.0)) / F.col("_r")
    )
    sched = rows.select(
        *keys, "LoanID", "month", "_r", "_A", "_haz", "_lgd", "_ls", "_j",
        # The first month starts from the principal itself; later ones from the
        # balance floored at zero.
        F.when(F.col("month") == 1, F.col("_prin")).otherwise(F.greatest(open_bal, F.lit(0.0))).alias("opening_balance"),
        # Month 1 always runs; later months only while the balance is positive.
        ((F.col("month") == 1) | (open_bal > BALANCE_STOP)).alias("_live"),
    )
    # A plain filter: it cannot move below the explode, and repeating the one
    # balance expression is cheaper than a generator per loan-month.
    sched = sched.where(F.col("_live"))
    interest = F.when(zero, F.lit(0.0)).otherwise(F.col("opening_balance") * F.col("_r"))
    survival = F.exp(F.col("_j") * F.col("_ls"))
    loss = survival * F.col("_haz") * F.col("_lgd") * F.col("opening_balance")
    log_disc = math.log1p(d)
    return sched.select(
        *keys, "LoanID", "month", "opening_balance",
        interest.alias("interest"),
        (F.col("_A") - interest).alias("principal"),
        survival.alias("survival"),
        (survival * F.col("_haz")).alias("default_mass"),
        loss.alias("loss"),
        (loss * F.exp(-(F.col("_j") + F.lit(1.0)) * F.lit(log_disc))).alias("loss_pv"),
    )


def _months(rows: DataFrame, n: str) -> DataFrame:
    """``rows`` once for each month 1 to ``n``, in nested blocks, so no array
    grows with the term."""
    last = ((F.col(n) - 1) / BLOCK).cast("int")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), (last / BLOCK).cast("int"))).alias("_outer"))
    first = F.col("_outer") * BLOCK
    rows = rows.select("*", F.explode(F.sequence(first, F.least(first + (BLOCK - 1), last))).alias("_inner"))
    first = F.col("_inner") * BLOCK
    return rows.select("*", F.explode(F.sequence(first + 1, F.least(first + BLOCK, F.col(n)))).alias("month")).drop("_outer", "_inner")


def schedule_by_month(df: DataFrame, discount_rate: float, stressed: bool = True) -> DataFrame:
    """The sums of ``amortisation_schedule`` by month, without its rows: n_loans,
    opening_balance, interest, principal, survival, default_mass, loss, loss_pv.

    What is left of a unit of principal after j months depends on rate and term
    alone, survival on the PD, and losses are proportional to principal times
    LGD. So loans of equal rate, term and PD are one cohort, told by the sums of
    its principals, payments and losses given default, and the months are those
    of cohorts: discrete rates, terms and scorecard PDs have a bounded number of
    them at any number of loans. Months that a loan no longer runs (its balance
    is gone early because its principal is tiny or not positive) are part of the
    cohort's key. With q = 1 + r the balance is 1 - (q^j - 1) / (q^n - 1), which
    has no cancellation at any rate or term.
    """
    sfx = "_st" if stressed else ""
    P, n, A = F.col("LoanAmount"), F.col("TermMonths"), F.col("MonthlyPayment" + sfx)
    rate = F.col("InterestRate_st" if stressed else "InterestRate_clean")
    df = df.where(P.isNotNull() & F.col("InterestRate_clean").isNotNull() & n.isNotNull())
    keys = [c for c in ("Scenario",) if c in df.columns]
    d = monthly_discount(discount_rate)
    loans = df.select(*keys, P.alias("_prin"), monthly_rate(rate).alias("_r"), n.alias("_n"), A.alias("_A"),
                      monthly_hazard(F.col("PD_12m" + sfx)).alias("_haz"), clip(F.col("LGD" + sfx), 0.0, 1.0).alias("_lgd"))
    zero = F.abs(F.col("_r")) < ZERO_RATE_EPS
    en = F.expm1(F.col("_n") * F.log1p(F.col("_r")))
    # The balance is above BALANCE_STOP for j below this.
    share = F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(BALANCE_STOP) / F.col("_prin"))
    until = F.when(zero, F.col("_n") * share).otherwise(F.log1p(share * en) / F.log1p(F.col("_r")))
    live = F.when(F.col("_prin") <= BALANCE_STOP, 1).otherwise(F.greatest(F.lit(1.0), F.least(F.col("_n").cast("double"), F.ceil(until))))
    known = F.col("_A").isNotNull() & F.col("_haz").isNotNull() & F.col("_lgd").isNotNull()
    loans = keep_where(loans.withColumn("_live", live.cast("int")), known)
    cohorts = loans.groupBy(*keys, "_r", "_n", "_haz", "_live").agg(
        F.count(F.lit(1)).alias("_k"), exact_sum("_prin").alias("_prin"), exact_sum("_A").alias("_A"),
        exact_sum(F.col("_prin") * F.col("_lgd")).alias("_lgdp"))
    cohorts = cohorts.select("*", F.log1p("_r").alias("_lg"), F.log1p(-F.col("_haz")).alias("_ls"),
                             F.expm1(F.col("_n") * F.log1p("_r")).alias("_en"))
    rows = _months(cohorts, "_live").withColumn("_j", (F.col("month") - 1).cast("double"))
    left = F.when(zero, F.lit(1.0) - F.col("_j") / F.col("_n")).otherwise(F.lit(1.0) - F.expm1(F.col("_j") * F.col("_lg")) / F.col("_en"))
    rows = rows.select(*keys, "month", "_k", "_r", "_A", "_haz", "_prin", "_lgdp", left.alias("_left"),
                       F.exp(F.col("_j") * F.col("_ls")).alias("_surv"),
                       F.exp(-F.col("month").cast("double") * F.lit(math.log1p(d))).alias("_disc"))
    balance = F.col("_prin") * F.col("_left")
    interest = F.when(zero, F.lit(0.0)).otherwise(balance * F.col("_r"))
    alive = F.col("_k") * F.col("_surv")
    loss = F.col("_surv") * F.col("_haz") * F.col("_lgdp") * F.col("_left")
    return rows.groupBy(*keys, "month").agg(
        F.sum("_k").alias("n_loans"), exact_sum(balance).alias("opening_balance"), exact_sum(interest).alias("interest"),
        exact_sum(F.col("_A") - interest).alias("principal"), exact_sum(alive).alias("survival"),
        exact_sum(alive * F.col("_haz")).alias("default_mass"), exact_sum(loss).alias("loss"),
        exact_sum(loss * F.col("_disc")).alias("loss_pv"))
