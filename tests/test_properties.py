"""Invariants on the driver-table portfolio."""

import pytest
from pyspark.sql import functions as F

from creditspark.operators.lifetime import amortisation_schedule
from creditspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def full(spark):
    run = catalogue._run(spark, SF)
    return run, run.full().cache()


def test_el_is_product_and_bounds(full):
    _, df = full
    bad = df.where(
        (F.abs(F.col("EL_12m_st") - F.col("PD_12m_st") * F.col("LGD_st") * F.col("EAD_12m_st")) > 1e-6)
        | ~F.col("PD_12m").between(0.002, 0.35)
        | ~F.col("PD_12m_st").between(0.002, 0.60)
        | ~(F.col("LGD_st").between(0.05, 0.95) | (F.col("LGD_st") == 0.6))
    )
    assert bad.count() == 0


def test_red_iff_negative_worst_headroom(full):
    _, df = full
    mismatch = df.where((F.col("Badge_st") == "Red") != F.coalesce(F.col("WorstHeadroom_st") < 0, F.lit(False)))
    assert mismatch.count() == 0


def test_tier_counts_sum_to_rows(full):
    _, df = full
    counts = df.groupBy("Scenario").agg(F.count("*").alias("n"), F.count("RiskTier_st").alias("t")).collect()
    assert all(r["n"] == r["t"] for r in counts)


def test_base_scenario_equals_base(full):
    _, df = full
    b = df.where("Scenario = 'Base' AND InterestRate_clean >= 0")
    assert b.where(F.abs(F.col("EL_12m_st") - F.col("EL_12m")) > 1e-9).count() == 0
    assert b.where(F.col("RiskTier_st") != F.col("RiskTier")).count() == 0


def test_lifetime_bounded_by_principal_times_lgd(full):
    _, df = full
    over = df.where((F.col("LoanAmount") > 0) & (F.col("EL_life_st") > F.col("LoanAmount") * F.col("LGD_st") + 1e-6))
    assert over.count() == 0


def test_stress_raises_lgd(full):
    _, df = full
    assert df.where("Scenario != 'Base' AND LGD_st < LGD - 1e-12").count() == 0


def test_closed_form_matches_schedule(full):
    run, df = full
    sched = amortisation_schedule(df, run.params.discount_rate, stressed=True)
    sums = sched.groupBy("Scenario", "LoanID").agg(F.sum("loss_pv").alias("el_sum"))
    joined = df.join(sums, ["Scenario", "LoanID"]).where(F.col("EL_life_st").isNotNull())
    rel = joined.select((F.abs(F.col("EL_life_st") - F.col("el_sum")) / F.greatest(F.abs("el_sum"), F.lit(1.0))).alias("d"))
    assert rel.agg(F.max("d")).collect()[0][0] < 1e-9
    assert joined.count() == df.where(F.col("EL_life_st").isNotNull()).count()


def test_schedule_repays_principal(full):
    run, df = full
    s = amortisation_schedule(df.where("LoanAmount > 0 AND InterestRate_st > 0"), run.params.discount_rate)
    repaid = s.groupBy("Scenario", "LoanID").agg(F.sum("principal").alias("p")).join(df, ["Scenario", "LoanID"])
    assert repaid.where(F.abs(F.col("p") - F.col("LoanAmount")) > 1e-6 * F.col("LoanAmount")).count() == 0


def test_masking_never_shows_more_than_four(spark):
    df = catalogue.masked_report(spark, SF)
    assert df.where(~F.col("LoanID").rlike(r"^\*\*\*\*.{0,4}$")).count() == 0


def test_distinct_base_pds_are_bounded(full):
    from creditspark.functions.scoring import (
        DTI_BANDS, LTV_BANDS, SCORE_BANDS, SECTOR_FACTORS, tier_key,
    )

    _, df = full
    bound = (len(SCORE_BANDS) + 1) * (len(DTI_BANDS) + 1) * (len(LTV_BANDS) + 1) * (len(set(SECTOR_FACTORS.values())) + 1)
    assert bound <= 6 * 4 * 4 * 7
    assert df.select(tier_key(F.col("PD_12m")).alias("x")).distinct().count() <= bound
