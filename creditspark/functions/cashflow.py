"""Amortisation cash flows as closed-form Column expressions.

All loops of the row-wise formulation collapse to powers of ``1 + r``, so the
whole cash-flow stack stays inside whole-stage codegen. The functions accept
the monthly rate and growth factors as precomputed columns, so a projection
layer can evaluate each ``pow`` once and reuse it by name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col, lit, nan_to_null

ZERO_RATE_EPS = 1e-12
_NULL = "double"


def monthly_rate(annual_rate) -> Column:
    return col(annual_rate) / F.lit(12.0)


def growth(r, periods) -> Column:
    """``(1 + r)^periods`` with the periods as a double."""
    p = F.lit(float(periods)) if isinstance(periods, (int, float)) else col(periods).cast("double")
    return F.pow(F.lit(1.0) + col(r), p)


def payment(P, R, n, r=None, g_n=None) -> Column:
    """Level monthly payment of an annuity; NULL on missing inputs or n <= 0.

    ``P*(1+r)^n / (((1+r)^n - 1)/r)``, i.e. ``pmt(r, n, -P)``; ``P/n`` when
    the monthly rate is (numerically) zero. Where the growth factor overflows
    (a very long term or high rate) the payment is missing, not NaN.
    """
    P, R, n = col(P), col(R), col(n)
    r = monthly_rate(R) if r is None else col(r)
    g = growth(r, n) if g_n is None else col(g_n)
    annuity = (P * g) / ((g - F.lit(1.0)) / r)
    return (
        F.when(P.isNull() | R.isNull() | n.isNull() | (n <= 0), F.lit(None).cast(_NULL))
        .when(F.abs(r) < ZERO_RATE_EPS, P / n)
        .otherwise(nan_to_null(annuity))
    )


def balance_at(P, R, n, k: int, A, r=None, g_k=None) -> Column:
    """Outstanding balance after ``k`` payments (C2), given the payment ``A``."""
    P, R, n, A = col(P), col(R), col(n), col(A)
    r = monthly_rate(R) if r is None else col(r)
    g = growth(r, k) if g_k is None else col(g_k)
    kk = F.lit(float(k))
    amortised = P * g - A * (g - F.lit(1.0)) / r
    straight = F.greatest(P - (P / n) * kk, F.lit(0.0))
    out = F.when(P.isNull() | R.isNull() | n.isNull(), F.lit(None).cast(_NULL))
    if k <= 0:
        return out.otherwise(P)
    return out.when(n <= k, F.lit(0.0)).when(F.abs(r) < ZERO_RATE_EPS, straight).otherwise(nan_to_null(amortised))


def first_year_interest(P, R, n, r=None) -> Column:
    """Interest paid over the first ``m = min(12, n)`` months.

    With ``q = 1 + r`` the annuity balance is ``B_j = P (q^n - q^j)/(q^n - 1)``,
    so the interest sum is

        sum_{j<m} r B_j = P (r m q^n - (q^m - 1)) / (q^n - 1),

    evaluated with ``E_k = q^k - 1 = expm1(k log1p(r))``. Unlike
    ``A*m - (P - B_m)`` it has no ``A/r`` term, so it keeps its precision at
    tiny rates (where that form cancels to ~1e-5 relative). A negative principal
    has no meaningful schedule and gives NULL; zero principal 0; overflow NULL.
    """
    P, R, n = col(P), col(R), col(n)
    r = monthly_rate(R) if r is None else col(r)
    nd = n.cast("double")
    m = F.least(n, F.lit(12)).cast("double")
    ln_q = F.log1p(r)
    e_n = F.expm1(nd * ln_q)
    e_m = F.expm1(m * ln_q)
    stable = P * (r * m * (F.lit(1.0) + e_n) - e_m) / e_n
    return (
        F.when(P.isNull() | R.isNull() | n.isNull() | (n <= 0), F.lit(None).cast(_NULL))
        .when(F.abs(r) < ZERO_RATE_EPS, F.lit(0.0))
        .when(P < 0, F.lit(None).cast(_NULL))
        .when(P == 0, F.lit(0.0))
        .otherwise(nan_to_null(stable))
    )


def cashflow_layers(rate_col: str, sfx: str = "") -> list[list[tuple[str, Column]]]:
    """Projection layers producing MonthlyPayment, AnnualDebtService,
    Balance_12m and Interest_Y1 (with ``sfx``) from LoanAmount, TermMonths and
    ``rate_col``; helper columns start with an underscore."""
    P, n, R = F.col("LoanAmount"), F.col("TermMonths"), F.col(rate_col)
    r, g_n, g12 = f"_r{sfx}", f"_gn{sfx}", f"_g12{sfx}"
    A = "MonthlyPayment" + sfx
    return [
        [(r, monthly_rate(R))],
        [(g_n, growth(F.col(r), n)), (g12, growth(F.col(r), 12))],
        [(A, payment(P, R, n, r=r, g_n=g_n))],
        [
            ("AnnualDebtService" + sfx, F.col(A) * F.lit(12.0)),
            ("Balance_12m" + sfx, balance_at(P, R, n, 12, A, r=r, g_k=g12)),
            ("Interest_Y1" + sfx, first_year_interest(P, R, n, r=r)),
        ],
    ]


def stressed_rate(R, rate_bps) -> Column:
    """Rate shock: ``max(R + bps/1e4, 0)``, NULL kept."""
    R = col(R)
    return F.when(R.isNotNull(), F.greatest(R + lit(rate_bps) / F.lit(10000.0), F.lit(0.0)))


def stressed_collateral(C, coll_drop) -> Column:
    """Collateral shock: ``max(C * (1 - drop/100), 1e-9)``, NULL kept."""
    C = col(C)
    return F.when(C.isNotNull(), F.greatest(C * (F.lit(1.0) - lit(coll_drop) / F.lit(100.0)), F.lit(1e-9)))
