"""Plan shape of registered queries (read from the final adaptive plan)."""

import re

import pytest

from tests.conftest import SF001
from tillroll.plans.analysis import RetailAnalysis
from tillroll.plans.catalog import QUERIES


def _final_plan(df) -> str:
    df._jdf.queryExecution().toRdd().count()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_cleaning_log_shares_the_dedup_exchange_in_one_plan(spark):
    """Both readers of the cleaned lines are in one plan: the dedup shuffle is reused,
    not recomputed and not written to a checkpoint."""
    df = QUERIES["cleaning_log"](spark, SF001)
    plan = _final_plan(df)
    assert "ReusedExchange" in plan
    assert "LogicalRDD" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan


def _scans(plan: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet [^\n]*/{table}\.parquet", plan))


def test_customer_aggregates_do_not_sort_or_expand_lines(spark):
    """The grain is one hash aggregate over the cleaned lines: no Expand, no object
    aggregate, no sort; features add no join to the source's own."""
    a = RetailAnalysis.from_test_tables(spark, SF001, cache=False)
    from tillroll.operators.customers import line_grain

    grain = _final_plan(line_grain(a.clean))
    features = _final_plan(a.features)
    for plan in (grain, features):
        assert "Expand" not in plan and "ObjectHashAggregate" not in plan
    assert "SortAggregate" not in grain
    assert "Sort [" not in grain.replace("SortMergeJoin [", "")
    assert features.count("Join") == _final_plan(a.clean).count("Join")


@pytest.mark.parametrize("name", ["customer_features", "cohort_sizes", "retention_cells", "cardinalities"])
def test_customer_queries_read_the_lines_once(spark, name):
    assert _scans(_final_plan(QUERIES[name](spark, SF001)), "lineitem") == 1


def test_reports_over_the_stored_grain_read_no_lines(spark):
    """Once the line grain is stored, features, KPIs, cohorts and the segments come from it;
    the cleaning log reads the raw lines for its first two steps only."""
    a = RetailAnalysis.from_test_tables(spark, SF001, cache=False)
    kpis = a.headline_kpis()
    for df in (kpis, a.features, a.retention_long(), a.segment_summary):
        assert "FileScan" not in _final_plan(df)
    assert _scans(_final_plan(a.cleaning_log()), "lineitem") == 1


def test_retention_needs_one_shuffle_by_customer(spark):
    plan = _final_plan(QUERIES["retention_cells"](spark, SF001))
    assert plan.count("hashpartitioning(CustomerID#") == 1  # the dedup is by all columns
    assert "Window" not in plan and "Expand" not in plan


def test_headline_kpis_read_the_stored_grain(spark):
    df = QUERIES["headline_kpis"](spark, SF001)
    plan = _final_plan(df)
    assert "FileScan" not in plan  # no second scan, join and dedup of the source tables
    assert "Expand" not in plan
    assert df.count() == 1


def test_a_ledger_commit_reads_its_month_only(spark, tmp_path):
    from tillroll.operators import customer_ledger as L
    from tillroll.params import test_table_params
    from tillroll.sources import tpch_adapter
    from tillroll.sources.io import load_line_items, write_line_items

    write_line_items(tpch_adapter.line_items(spark, SF001), str(tmp_path / "lines"))
    month = L.window_months(test_table_params())[3]
    lines = load_line_items(spark, str(tmp_path / "lines"), params=month)
    assert sorted({f.split("invoice_month=")[1][:7] for f in lines.inputFiles()}) != ["1997-04"]  # the table has more
    plan = _final_plan(lines)
    assert re.search(r"PartitionFilters: \[[^\]]*1997-04", plan)


def test_histogram_reads_its_source_once(spark):
    plan = _final_plan(QUERIES["quantity_histogram"](spark, SF001))
    assert "ReusedExchange" in plan


def test_summary_with_a_model_folds_from_the_stored_grain(spark, monkeypatch):
    from tillroll.plans import catalog

    monkeypatch.setattr(catalog.M, "ltv_study", lambda scored, params: None)
    monkeypatch.setattr(catalog, "summary_frame", lambda a, ltv: a)
    a = catalog.q_summary(spark, SF001)
    assert "lineitem" not in a.features._jdf.queryExecution().toString()


def test_orders_meet_customers_before_lines(spark):
    from tillroll.sources import tpch_adapter

    plan = tpch_adapter.line_items(spark, SF001)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {k: next(row.index("Join") for row in plan if "Join" in row and k in row) for k in ("o_custkey", "l_orderkey")}
    assert depth["o_custkey"] > depth["l_orderkey"]
