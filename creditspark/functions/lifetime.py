"""Lifetime expected loss (L1, L3) as a closed form over the amortisation curve.

The month-by-month definition is

    EL = sum_{m=1..n} S_{m-1} * p * LGD * B_{m-1} / (1 + d)^m

with monthly hazard ``p``, survival ``S_j = (1-p)^j``, monthly discount ``d``
and opening balance ``B_j``. With ``u = (1-p)/(1+d)``, ``v = u(1+r)`` and
``G(q) = sum_{j<n} q^j = (q^n - 1)/(q - 1)`` the annuity balance
``B_j = P (q^n - q^j) / (q^n - 1)`` (``q = 1 + r``) gives

    EL = p*LGD*P / ((1+d)(q^n - 1)) * [q^n G(u) - G(v)]

and the straight-line (zero-rate) balance ``B_j = P - jP/n`` gives

    EL = p*LGD/(1+d) * [P G(u) - (P/n) sum_{j<n} j u^j].

``G`` is evaluated as ``expm1(n*log1p(x))/x`` with ``x = q - 1`` formed
directly, which keeps full precision near ``q = 1``. A principal <= 0 has
a single month of exposure (the schedule stops once the balance is gone).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cashflow import ZERO_RATE_EPS, monthly_rate
from .core import clip, col, nan_to_null

# --- Fixed values that must equal the reference's for identical results -----
HAZARD_PD_FLOOR, HAZARD_PD_CAP = 1e-9, 0.99
BALANCE_STOP = 1e-8
DISCOUNT_GUARD = -0.9999
# ---------------------------------------------------------------------------


def monthly_hazard(pd12) -> Column:
    """``1 - (1 - PD)^(1/12)``; 0 for missing or non-positive PD (L1)."""
    pd12 = col(pd12)
    p = F.least(F.greatest(pd12, F.lit(HAZARD_PD_FLOOR)), F.lit(HAZARD_PD_CAP))
    hazard = F.lit(1.0) - F.pow(F.lit(1.0) - p, F.lit(1.0 / 12.0))
    return F.when(pd12.isNull() | (pd12 <= 0), F.lit(0.0)).otherwise(hazard)


def monthly_discount(discount_rate_annual: float) -> float:
    d = float(discount_rate_annual) / 12.0
    # The reference skips discounting below the guard; that equals d = 0.
    return d if d > DISCOUNT_GUARD else 0.0


def _geometric_sum(x: Column, n: Column) -> Column:
    """sum_{j<n} (1+x)^j, exact at x = 0."""
    return F.when(x == 0, n.cast("double")).otherwise(F.expm1(n * F.log1p(x)) / x)


# Below this |n x| the closed form of the weighted sum loses digits to
# cancellation and its series in x converges in a few terms.
SERIES_BELOW = 1e-3


def _weighted_geometric_sum(x: Column, n: Column, g: Column) -> Column:
    """sum_{j<n} j u^j for u = 1 + x, given g = sum_{j<n} u^j.

    The derivative of the geometric sum gives (n u^n - u g) / x. Near x = 0 the
    binomial series sum_k x^k sum_j j C(j, k) is used, with the sums over j as
    sums of powers; four terms leave an error below |n x|^4. Both are a fixed
    number of operations per row.
    """
    m = n.cast("double")
    one = F.lit(1.0)
    s1 = m * (m - one) / 2.0
    s2 = s1 * (m * 2.0 - one) / 3.0
    s3 = s1 * s1
    s4 = s2 * (m * m * 3.0 - m * 3.0 - one) / 5.0
    series = s1 + x * (s2 + x * ((s3 - s2) / 2.0 + x * (s4 - s3 * 3.0 + s2 * 2.0) / 6.0))
    closed = (m * F.exp(m * F.log1p(x)) - (one + x) * g) / x
    return F.when(F.abs(m * x) < SERIES_BELOW, series).otherwise(closed)


def lifetime_el_layers(P, R, n, pd12, lgd, discount_rate_annual: float, out: str, tag: str):
    """Projection layers computing the present value of lifetime expected loss
    (L3) into column ``out``; NULL when any of principal, rate, term (> 0), PD or
    LGD is missing. Helper columns are named ``_<tag>_*``.

    Annuity case: with ``q = 1 + r``, ``B_j = P (q^n - q^j)/(q^n - 1)``, so
    ``EL = p LGD P / ((1+d) E_n) * ((1 + E_n) G(u) - G(v))`` with
    ``E_n = q^n - 1 = expm1(n log1p(r))``; no ``A/r`` term, hence no
    cancellation at tiny rates.
    """
    P, R, n, pd12, lgd = col(P), col(R), col(n), col(pd12), col(lgd)
    h = lambda name: f"_{tag}_{name}"
    c = lambda name: F.col(h(name))
    d = monthly_discount(discount_rate_annual)
    one_d = F.lit(1.0 + d)
    r = monthly_rate(R)
    nd = n.cast("double")
    missing = P.isNull() | R.isNull() | n.isNull() | (n <= 0) | pd12.isNull() | lgd.isNull()
    return [
        [(h("p"), monthly_hazard(pd12)), (h("r"), r)],
        [
            (h("lr"), c("p") * clip(lgd, 0.0, 1.0) / one_d),
            (h("xu"), (-c("p") - F.lit(d)) / one_d),
            (h("xv"), (c("r") - c("p") - c("p") * c("r") - F.lit(d)) / one_d),
            (h("en"), F.expm1(nd * F.log1p(c("r")))),
        ],
        [
            (h("gu"), _geometric_sum(c("xu"), n)),
            (h("gv"), _geometric_sum(c("xv"), n)),
        ],
        [(out,
          F.when(missing, F.lit(None).cast("double"))
          .when(c("p") == 0, F.lit(0.0))
          .when(P <= 0, c("lr") * P)
          .when(F.abs(c("r")) < ZERO_RATE_EPS,
                c("lr") * (P * c("gu") - (P / n) * _weighted_geometric_sum(c("xu"), n, c("gu"))))
          .otherwise(nan_to_null(c("lr") * P * ((F.lit(1.0) + c("en")) * c("gu") - c("gv")) / c("en"))))],
    ]
