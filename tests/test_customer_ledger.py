"""The customer ledger: totals equal a recount, commits are idempotent, torn writes are not read."""

import pytest

from tests.conftest import SF001
from tests.helpers import frame, line
from tillroll.operators import clean as CL
from tillroll.operators import customers as CU
from tillroll.operators.customer_ledger import CustomerLedger, month_name, window_months
from tillroll.params import AnalysisParams
from tillroll.params import test_table_params as table_params
from tillroll.plans.analysis import RetailAnalysis
from tillroll.session import list_folders

P = AnalysisParams()


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def study(spark):
    a = RetailAnalysis.from_test_tables(spark, SF001, cache=False)
    return a, a.clean.persist()


def month_lines(clean, month):
    return CL.trim_window(clean, month)


def test_window_is_cut_at_the_months():
    months = window_months(P)
    assert len(months) == P.n_periods and month_name(months[0]) == "2010-12"
    assert months[0].start_ts == P.start_ts and months[-1].end_ts == P.end_ts
    assert month_name(window_months(table_params())[-1]) == "1997-12"


def test_totals_after_every_commit_equal_a_recount(spark, study, tmp_path):
    a, clean = study
    ledger = CustomerLedger(spark, str(tmp_path / "ledger"))
    assert ledger.features(a.params) is None
    months = window_months(a.params)
    for k, month in enumerate(months):
        assert ledger.commit(month_name(month), "b1", month_lines(clean, month))
        assert not ledger.commit(month_name(month), "b1", month_lines(clean, month))
        if k in (3, 7):
            assert ledger.compact() and not ledger.compact()
        if k in (0, 4, 11):
            so_far = clean.where(CL.in_window(a.params.with_(window_end=month.window_end)))
            assert rows(ledger.features(a.params)) == rows(CU.customer_features(CL.with_customer(so_far), a.params))
    assert rows(ledger.features(a.params)) == rows(a.features)


def test_revision_replaces_a_month_and_outdates_the_base(spark, tmp_path):
    ledger = CustomerLedger(spark, str(tmp_path / "ledger"))
    of = lambda *ls: CL.clean_line_items(frame(spark, ls), P)
    may = line("1", "A", 2, "2011-05-01 10:00:00", 3.0, 7)
    june = line("2", "A", 1, "2011-06-01 10:00:00", 5.0, 7)
    ledger.commit("2011-05", "x", of(may))
    ledger.commit("2011-06", "x", of(june))
    ledger.compact()
    late = line("3", "B", 1, "2011-05-09 10:00:00", 7.0, 7)
    assert ledger.commit("2011-05", "y", of(may, late))
    got = ledger.features(P).first()
    assert float(got["Monetary"]) == 18.0 and got["Frequency"] == 3 and got["DistinctStockCodes"] == 2
    assert not ledger.commit("2011-05", "x", of(may))  # an old batch does not come back
    assert ledger.compact() and float(ledger.features(P).first()["Monetary"]) == 18.0


def test_torn_writes_are_not_read(spark, tmp_path):
    ledger = CustomerLedger(spark, str(tmp_path / "ledger"))
    of = lambda *ls: CL.clean_line_items(frame(spark, ls), P)
    ledger.commit("2011-05", "x", of(line("1", "A", 2, "2011-05-01 10:00:00", 3.0, 7)))
    torn = tmp_path / "ledger" / "month=2011-05" / "v=000002-y"
    CU.customer_facets(CU.measured(of(line("9", "A", 9, "2011-05-01 10:00:00", 9.0, 9)))).write.parquet(str(torn))
    (torn / "_SUCCESS").unlink()
    assert [r["CustomerID"] for r in ledger.features(P).collect()] == [7]
    assert ledger.commit("2011-05", "y", of(line("1", "A", 4, "2011-05-01 10:00:00", 3.0, 7)))
    assert list_folders(spark, str(tmp_path / "ledger" / "month=2011-05"))[-1] == "v=000003-y"
    assert float(ledger.features(P).first()["Monetary"]) == 12.0
    base = tmp_path / "ledger" / "base" / "v=000001" / "state"
    CU.customer_facets(CU.measured(of())).write.parquet(str(base))  # a compaction that broke off
    assert float(ledger.features(P).first()["Monetary"]) == 12.0


def test_empty_month_and_bad_batch_name(spark, tmp_path):
    ledger = CustomerLedger(spark, str(tmp_path / "ledger"))
    empty = CL.clean_line_items(frame(spark, []), P)
    assert ledger.commit("2011-05", "none", empty)
    assert ledger.features(P).count() == 0
    with pytest.raises(ValueError):
        ledger.commit("2011-05", "a/b", empty)


def test_a_base_alone_is_not_merged_again(spark, tmp_path):
    ledger = CustomerLedger(spark, str(tmp_path / "ledger"))
    of = lambda *ls: CL.clean_line_items(frame(spark, ls), P)
    for month in (5, 6):
        ledger.commit(f"2011-0{month}", "x", of(line(str(month), "A", 2, f"2011-0{month}-01 10:00:00", 3.0, 7)))
    assert "Aggregate" in ledger.state()._jdf.queryExecution().optimizedPlan().toString()
    ledger.compact()
    assert "Aggregate" not in ledger.state()._jdf.queryExecution().optimizedPlan().toString()
    assert float(ledger.features(P).first()["Monetary"]) == 12.0
