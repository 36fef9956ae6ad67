"""Snapshots are published whole; repeated and missing LoanIDs change nothing. S5, S6: reruns."""

import os

import pytest
from pyspark.sql import functions as F

from creditspark.operators import snapshot as S
from creditspark.sources import publish as P
from creditspark.operators.covenants import exceptions
from creditspark.operators.report import display_pricing, pricing_export_name, write_exceptions_csv, write_pricing_table
from creditspark.params import RunParams
from creditspark.plans.portfolio import run_portfolio
from creditspark.sources.sample import sample_portfolio


def doubled(spark):
    """The sample three times under the same ids, and once without an id; the
    second copy breaks a rule that the others keep."""
    loans = sample_portfolio(spark)
    bad = loans.withColumn("CreditScore", F.lit(900.0))
    return loans.unionByName(bad).unionByName(loans).unionByName(loans.withColumn("LoanID", F.lit(None).cast("string")))


@pytest.mark.parametrize("mask", [True, False])
def test_repeated_and_null_ids(spark, scratch, mask):
    run = run_portfolio(spark, doubled(spark))
    snap = S.write_snapshot(spark, run, scratch, mask=mask)
    want = {r["Scenario"]: r.asDict() for r in run.kpis().collect()}
    got = {r["Scenario"]: r.asDict() for r in snap.table("kpis").collect()}
    assert snap.rows["loans"] == 3 * 40 and set(got) == set(want)
    for name, row in want.items():
        assert got[name]["n_loans"] == row["n_loans"] == 40
        for k, v in row.items():
            assert got[name][k] == (pytest.approx(v, rel=1e-12, abs=1e-9) if isinstance(v, float) else v), k
    # Each row has its own issues: only the bad copy's score is out of range.
    loans = snap.table("loans").where("Scenario = 'Base'")
    assert loans.where(F.col("Issues").contains("CreditScore")).count() == 10
    assert loans.where(F.col("Issues").contains("CreditScore") & (F.col("CreditScore") != 900)).count() == 0
    plan = snap.table("kpis")
    assert plan.columns[-1] == "snapshot_id" and snap.verify() is snap


def test_base_and_stressed_risk_are_tables(spark, scratch):
    run = run_portfolio(spark, sample_portfolio(spark))
    snap = S.write_snapshot(spark, run, scratch, mask=False)
    assert snap.rows["base_risk"] == 10 and snap.rows["stressed_risk"] == 30
    assert snap.table("base_risk").columns == ["LoanID", "PD_12m", "LGD", "EAD_12m", "EL_12m", "RiskTier", "snapshot_id"]


def test_a_write_that_fails_publishes_nothing(spark, scratch, monkeypatch):
    run = run_portfolio(spark, sample_portfolio(spark))
    stage, done = P.Publisher.stage_table, []

    def fails(self, name, df, *more):
        if len(done) == 5:
            raise RuntimeError("lost")
        done.append(name)
        return stage(self, name, df, *more)

    monkeypatch.setattr(P.Publisher, "stage_table", fails)
    with pytest.raises(RuntimeError):
        S.write_snapshot(spark, run, scratch, snapshot_id="X")
    with pytest.raises(P.PublishError, match="not published"):
        S.read_snapshot(spark, scratch, "X")
    assert not os.path.exists(os.path.join(scratch, "X"))
    monkeypatch.undo()
    # The same id can be published by a later attempt, once.
    first = S.write_snapshot(spark, run, scratch, snapshot_id="X")
    assert S.read_snapshot(spark, scratch, "X") == first
    with pytest.raises(P.PublishError, match="already published"):
        S.write_snapshot(spark, run, scratch, snapshot_id="X")


def test_row_counts_are_checked(spark, scratch):
    run = run_portfolio(spark, sample_portfolio(spark))
    snap = S.write_snapshot(spark, run, scratch, snapshot_id="Y")
    snap.table("kpis").limit(1).write.mode("append").parquet(snap.paths["kpis"])
    with pytest.raises(P.PublishError, match="kpis"):
        S.read_snapshot(spark, scratch, "Y").verify()
    with pytest.raises(P.PublishError, match="no table"):
        snap.table("nothing")


def test_issues_need_no_join(spark):
    from creditspark.operators.quality import with_issues

    plan = with_issues(run_portfolio(spark, sample_portfolio(spark)).full())._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_rerun_replaces_only_its_scenarios(spark, scratch):
    run = run_portfolio(spark, sample_portfolio(spark))
    table, path = display_pricing(run.pricing()), os.path.join(scratch, "pricing")
    rows = lambda: sorted(map(tuple, spark.read.parquet(path).select(table.columns).collect()), key=repr)
    write_pricing_table(table, path, rows_per_file=4)
    whole = rows()
    assert len(whole) == 30
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(files) >= 9  # four rows each
    untouched = {f: os.path.getmtime(f"{path}/Scenario=Base/{f}") for f in os.listdir(f"{path}/Scenario=Base")}
    write_pricing_table(table.where("Scenario = 'Severe'"), path, scenarios=["Severe"])
    assert rows() == whole
    assert untouched == {f: os.path.getmtime(f"{path}/Scenario=Base/{f}") for f in os.listdir(f"{path}/Scenario=Base")}
    # A scenario that was run and has no rows loses the rows of the run before.
    write_pricing_table(table.where("Scenario = 'Severe' and false"), path, scenarios=["Severe"])
    assert {r[0] for r in rows()} == {"Base", "Adverse"} and len(rows()) == 20


def test_exceptions_rerun_as_csv(spark, scratch):
    found = exceptions(run_portfolio(spark, sample_portfolio(spark)).covenants())
    path = os.path.join(scratch, "exceptions")
    for _ in range(2):
        write_exceptions_csv(found, path, scenarios=["Base", "Adverse", "Severe"])
        back = spark.read.option("header", True).csv(path)
        assert back.count() == found.count()
    with pytest.raises(ValueError):
        write_pricing_table(found, path, fmt="orc")


def test_export_name():
    import datetime

    assert pricing_export_name("Severe", datetime.datetime(2024, 5, 6, 7, 8, 9)) == "pricing_table_Severe_20240506_070809"


def test_tier_filter_moves_no_loans(spark):
    run = run_portfolio(spark, sample_portfolio(spark), RunParams(tier="High"))
    plan = run.view._jdf.queryExecution().executedPlan().toString()
    body = plan.split("Subqueries")[0].split("Subquery subquery")[0]
    assert "Exchange hashpartitioning(Scenario" not in body and "Join" not in body
    kept = {(r["Scenario"], r["RiskTier_st"]) for r in run.view.collect()}
    every = {(r["Scenario"], r["RiskTier_st"]) for r in run.stressed.collect()}
    for s in {s for s, _ in every}:
        want = {t for x, t in every if x == s}
        assert {t for x, t in kept if x == s} == ({"High"} if "High" in want else want)
