"""Totals that do not depend on the partitioning, months by cohorts."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from creditspark.functions.sums import LARGE, UNIT_BITS, exact_sum
from creditspark.operators import aggregates as agg
from creditspark.operators.lifetime import amortisation_schedule, schedule_by_month
from creditspark.params import RunParams
from creditspark.plans import catalogue
from creditspark.plans.portfolio import run_portfolio

SF = "/root/testdata/sf0.001"


def exact(values):
    """Of the values' multiples of a unit, in whole numbers."""
    total = 0
    for v in values:
        f = Fraction(v) * (1 << UNIT_BITS)
        whole = math.floor(f)
        rest = f - whole
        total += whole + (rest > Fraction(1, 2) or rest == Fraction(1, 2) and whole % 2)
    return float(Fraction(total, 1 << UNIT_BITS))


def test_sums_are_exact(spark):
    rng = random.Random(1)
    groups = {
        "money": [rng.uniform(-1e6, 1e6) for _ in range(3000)],
        "wide": [rng.choice([1, -1]) * 10 ** rng.uniform(-9, 17) for _ in range(3000)],
        "cancel": [1e16, 1.0, -1e16, 2.0**-30, 2.0**-31, 3 * 2.0**-31],
        "none": [None, None], "zero": [0.0, -0.0, None],
        "edge": [math.nextafter(LARGE, 0), -math.nextafter(LARGE, 0), 5.25],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    for parts in (1, 7, 211):
        got = {r.g: r.s for r in df.repartition(parts).groupBy("g").agg(exact_sum("v").alias("s")).collect()}
        assert got == {g: exact([v for v in vs if v is not None]) for g, vs in groups.items()}
    big = spark.createDataFrame([(LARGE * 4,), (1.5,), (-LARGE,)], "v double")
    assert big.agg(exact_sum("v")).head()[0] == LARGE * 3 + 1.5
    assert df.where("false").agg(exact_sum("v")).head()[0] == 0.0


def test_totals_are_the_same_under_any_partitioning(spark):
    raw = catalogue._run.__globals__["loans"](spark, SF)
    seen = []
    for parts in (1, 7, 211):
        run = run_portfolio(spark, raw.repartition(parts), RunParams())
        tables = (run.kpis_base(), run.kpis(), agg.lifetime_totals(run.lifetime()), agg.portfolio_pricing(run.view),
                  agg.ead_by(run.view, "Sector"), agg.top3_sector_share(run.view), schedule_by_month(run.view, 0.06))
        seen.append([sorted(map(tuple, t.collect()), key=repr) for t in tables])
    assert seen[0] == seen[1] == seen[2]


def test_two_step_totals_equal_one_step(spark):
    run = run_portfolio(spark, catalogue._run.__globals__["loans"](spark, SF))
    assert sorted(map(tuple, run.kpis().collect())) == sorted(map(tuple, agg.kpis_by_scenario(run.view).collect()))


@pytest.mark.parametrize("stressed", [True, False])
def test_cohort_months_equal_the_sums_of_loans(spark, stressed):
    run = catalogue._run(spark, SF)
    view = run.view
    odd = view.where("LoanID like '%7'").withColumn("LoanAmount", F.expr(
        "case when LoanID like '%17' then -5.0 when LoanID like '%27' then 1e-9 when LoanID like '%37' then 2e-8 else 0.0 end"))
    odd = odd.withColumns({f"MonthlyPayment{s}": F.col(f"MonthlyPayment{s}") * 0 + 1e-9 for s in ("", "_st")})
    for df in (view, odd):
        loans = amortisation_schedule(df, 0.06, stressed)
        names = ("opening_balance", "interest", "principal", "survival", "default_mass", "loss", "loss_pv")
        want = {(r.Scenario, r.month): r for r in loans.groupBy("Scenario", "month").agg(
            F.count("*").alias("n_loans"), *[F.sum(c).alias(c) for c in names]).collect()}
        got = {(r.Scenario, r.month): r for r in schedule_by_month(df, 0.06, stressed).collect()}
        if df is view:
            assert set(got) == set(want)
            for k, w in want.items():
                assert got[k].n_loans == w.n_loans, k
                for c in names:
                    assert got[k][c] == pytest.approx(w[c], rel=1e-9, abs=1e-6), (k, c)
        else:
            assert all(got[s, 1].n_loans == want[s, 1].n_loans and got[s, 1].opening_balance == pytest.approx(want[s, 1].opening_balance)
                       for s in {s for s, _ in want})


def test_months_are_those_of_cohorts(spark):
    plan = catalogue.amortisation_schedule_q(spark, SF)._jdf.queryExecution().executedPlan().toString()
    first = plan.index("Generate explode(sequence")  # the topmost is last in the plan's text order
    below = plan[first:]
    assert below.count("HashAggregate") >= 2  # cohorts are grouped below the months
    assert "Generate explode(sequence" not in below.split("partial_count(1)")[-1]
