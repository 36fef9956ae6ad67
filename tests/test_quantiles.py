"""Exact percentiles by range refinement; cuts of PDs that all differ; ids by position."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.operators import clean as C
from creditspark.operators.quantiles import SHIFTS, exact_percentiles
from creditspark.operators.rankings import top_k
from creditspark.operators.tiers import tier_cuts
from creditspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 1000])
def test_percentiles_by_group(spark, n):
    rng = random.Random(n)
    rows = [(g, rng.choice([rng.randrange(1 << 40), rng.randrange(50), 7]), rng.randint(1, 4)) for g in ("a", "b") for _ in range(n)]
    rows += [("a", None, 3), ("none", None, 2)]
    out = exact_percentiles(spark.createDataFrame(rows, "g string, k long, n long"), ["g"], "k", "n", (0.0, 0.33, 0.66, 1.0))
    got = {r.g: r for r in out.collect()}
    assert set(got) == {"a", "b"}
    for g in got:
        every = np.sort(np.array([k for x, k, m in rows if x == g and k is not None for _ in range(m)], dtype=float))
        assert got[g].total == len(every)
        assert got[g].q == pytest.approx(np.percentile(every, [0, 33, 66, 100]).tolist(), rel=1e-12)


def test_a_million_distinct_pds(spark):
    n = 1_000_000
    pds = spark.range(n, numPartitions=8).select(((F.col("id") * 7_919 % n + 0.5) / n).alias("PD_12m"))
    pds = pds.unionByName(spark.createDataFrame([(None,)] * 3, "PD_12m double"))
    got = tier_cuts(pds, discrete=False).head()
    want = np.percentile((np.arange(n) + 0.5) / n, [33, 66])
    assert got.n_pd == n and (got.q_low, got.q_high) == pytest.approx(want.tolist(), abs=2e-12)
    # No step sees more rows in one task than a histogram has ranges.
    steps = [SHIFTS[0] - SHIFTS[1], SHIFTS[1] - SHIFTS[2], 40 - SHIFTS[0]]
    assert max(steps) <= 14
    keys = pds.select(F.rint(F.col("PD_12m") * 1e12).cast("long").alias("k"))
    assert keys.select(F.shiftright("k", SHIFTS[0])).distinct().count() <= 1 << 14


def test_refined_cuts_equal_the_scorecards(spark):
    base = catalogue._run(spark, SF).base
    assert tier_cuts(base, discrete=False).head() == tier_cuts(base).head()
    none = base.where("false")
    assert tier_cuts(none, discrete=False).head() == tier_cuts(none).head()


def test_top_k_reads_the_loans_once(spark):
    for q in (catalogue.watchlist_top10, catalogue.watchlist_tab, catalogue.top_spread):
        plan = q(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet [o_") == 1 and plan.count("WindowGroupLimit") >= 2, q.__name__
    # Tiers need the cuts of all loans, one narrow pass more; without them the loans are read once here as well.
    view = catalogue._run(spark, SF).view
    plan = top_k(view, "EAD_12m_st").drop("RiskTier", "RiskTier_st")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [o_") == 1 and "Subquery" not in plan


def test_top_k_with_repeated_ids(spark):
    rows = [("s", "same", float(k % 5)) for k in range(50)] + [("t", "one", None)]
    df = spark.createDataFrame(rows, "Scenario string, LoanID string, x double").repartition(7)
    got = [(r.Scenario, r["rank"], r.x) for r in top_k(df, "x", 12).orderBy("Scenario", "rank").collect()]
    assert got == [("s", k + 1, 4.0 if k < 10 else 3.0) for k in range(12)] + [("t", 1, None)]


def test_ids_of_a_scan_need_no_exchange_of_loans(spark, scratch):
    path = os.path.join(scratch, "loans")
    spark.range(1000).select(F.lit("Retail").alias("Sector"), F.col("id").alias("LoanAmount")).repartition(9).write.parquet(path)
    scan = spark.read.parquet(path).where("LoanAmount >= 0")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ids", "plan")
    ids = C.with_generated_ids(scan)
    assert jobs.getJobIdsForGroup("ids") == []
    plan = ids._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(_part#" in plan  # that of the counts, by partition
    loans_side = plan[: plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in loans_side
    spark.sparkContext.setJobGroup("other", "run")
    got = sorted(r.LoanID for r in ids.collect())
    assert got == sorted(f"L-{k:03d}" for k in range(1, 1001))


def test_ids_with_more_partitions_than_are_broadcast(spark, scratch, monkeypatch):
    monkeypatch.setattr(C, "_MOST_BROADCAST", 1)
    monkeypatch.setattr(C, "_ID_GROUP", 2)
    path = os.path.join(scratch, "loans")
    spark.range(100).repartition(5).write.parquet(path)
    ids = C.with_generated_ids(spark.read.parquet(path).repartition(5))
    assert sorted(r.LoanID for r in ids.collect()) == sorted(f"L-{k:03d}" for k in range(1, 101))
