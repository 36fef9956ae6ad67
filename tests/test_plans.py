"""Plan shape: no Python evaluation, no cartesian product, pushed filters, bounded top-k."""

from creditspark.operators import aggregates as A
from creditspark.operators.rankings import top_k
from creditspark.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_and_no_cartesian(spark):
    for name, q in catalogue.QUERIES.items():
        p = plan(q(spark, SF))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "CartesianProduct" not in p, name


def test_scenarios_expand_without_join_and_cuts_scalar(spark):
    p = plan(catalogue.stressed_risk(spark, SF))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
    assert "Generate inline" in p  # one row per (loan, scenario) from a literal array
    assert "Subquery" in p  # the tier cutpoints
    assert "SortMergeJoin" not in p


def test_kpis_read_the_loans_once(spark):
    for q in (catalogue.kpis_base, catalogue.kpis_by_scenario, catalogue.tier_histogram, catalogue.kpis_tier_high,
              catalogue.top3_sector_share, catalogue.tier_cuts_q):
        p = plan(q(spark, SF))
        assert p.count("orders.parquet") == 1 and "Subquery" not in p, q.__name__


def test_lifetime_has_no_fold_and_stays_in_generated_code(spark):
    df = catalogue.lifetime_totals(spark, SF)
    df.collect()
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in p and "lambdafunction" not in p
    final = p.split("== Initial Plan ==")[0]
    projects = [line for line in final.split("\n") if "Project [" in line and "EL_life" in line]
    assert projects and all("*(" in line for line in projects)


def test_unused_tiers_prune_the_cut_pass(spark):
    p = plan(catalogue.covenant_table(spark, SF))
    assert "Subquery" not in p and "percentile" not in p.lower()


def test_badge_filter_stays_above_scoring(spark):
    p = plan(catalogue.exceptions_q(spark, SF))
    filters = [line for line in p.split("\n") if line.strip().startswith(("Filter", "+- Filter"))]
    assert all("DSCR" not in line and "POWER" not in line for line in filters)
    assert "Generate explode(CASE WHEN Badge_st" in p


def test_global_top_k_is_take_ordered(spark):
    run = catalogue._run(spark, SF)
    p = plan(top_k(run.view, "EAD_12m_st", 10, by=None))
    assert "TakeOrderedAndProject" in p


def test_scan_reads_only_needed_columns(spark):
    df = catalogue.tier_cuts_q(spark, SF)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "o_orderdate" not in p and "o_orderstatus" not in p
