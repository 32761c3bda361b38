"""Profile tables from the stored grain, sketches by month, copies by hash: against the plain way."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tests.helpers import frame, line
from tillroll.operators import cohorts as H
from tillroll.operators import clean as CL
from tillroll.operators import customers as CU
from tillroll.operators import profile as Q
from tillroll.params import AnalysisParams
from tillroll.plans.analysis import RetailAnalysis
from tillroll.sources.schema import RAW_COLUMNS

P = AnalysisParams()


@pytest.fixture(scope="module")
def study(spark):
    return RetailAnalysis.from_test_tables(spark, SF001, cache=False)


def rows(df):
    return sorted(map(str, df.collect()))


def test_tables_from_the_grain_equal_tables_from_the_lines(study):
    raw, p = study.raw, study.params
    tables = study.profile().tables()
    plain = {
        "rows_per_month": Q.rows_per_month(raw),
        "top_countries_by_rows": Q.top_countries_by_rows(raw, p.top_countries_by_rows),
        "null_profile": Q.null_profile(raw),
        "date_range": Q.date_range(raw),
        "monthly_net_revenue": Q.monthly_net_revenue(raw),
        "country_revenue": Q.country_revenue(raw, p.top_countries_by_revenue),
        "invoice_sizes": Q.invoice_sizes(raw),
        "purchases_vs_returns": Q.purchases_vs_returns(raw, p),
    }
    assert set(tables) == set(plain) | {"cardinalities", "quality_flags"}
    for name, df in plain.items():
        assert rows(tables[name]) == rows(df), name


def test_copies_by_hash_equal_copies_by_row(spark, study):
    got = Q.quality_flags(study.raw, study.params).first()
    groups = study.raw.groupBy(*RAW_COLUMNS).count()
    assert got["exact_duplicates"] == groups.agg(F.sum(F.col("count") - 1)).first()[0]
    near = [
        line("1", "A", 1, "2011-05-01 10:00:00", 2.0, None),
        line("1", "A", 1, "2011-05-01 10:00:00", 2.0, None),  # a copy
        line("A", "1", 1, "2011-05-01 10:00:00", 2.0, None),  # the same values in other columns
        line("1", "A", 1, "2011-05-01 10:00:00", 2.0, None, desc="United Kingdom", country="A"),
        line("1", "A", 1, "2011-05-01 10:00:00", 2.0, None, country="A"),
    ]
    assert Q.quality_flags(frame(spark, near), P).first()["exact_duplicates"] == 1
    assert Q.quality_flags(frame(spark, []), P).first()["rows"] is None


def test_hashes_are_shuffled_in_place_of_lines(study):
    plan = Q.quality_flags(study.raw, study.params)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "hashpartitioning(_h0" in x]
    assert dealt and not any("Description" in x for x in dealt)


def test_sketches_merge_over_any_months(spark, study):
    """A roll-up of month sketches is near the exact counts, and merging in parts changes nothing."""
    raw = study.raw
    sketches = Q.month_sketches(raw).persist()
    exact = Q.cardinalities(raw).first()
    rolled = Q.cardinalities_from_sketches(sketches).first()
    assert (rolled["rows"], rolled["span_days"]) == (exact["rows"], exact["span_days"])
    bound = 3 * 1.04 / 2 ** (Q.SKETCH_BITS / 2)
    for k in Q.CARDINALITIES:
        assert abs(rolled[k] - exact[k]) <= bound * exact[k] + 1
    some = sketches.where("month >= '1995-01-01' AND month < '1996-01-01'")
    lines = raw.where("InvoiceDate >= '1995-01-01' AND InvoiceDate < '1996-01-01'")
    part, want = Q.cardinalities_from_sketches(some).first(), Q.cardinalities(lines).first()
    for k in Q.CARDINALITIES:
        assert abs(part[k] - want[k]) <= bound * want[k] + 1
    sketches.unpersist()
    none = Q.cardinalities_from_sketches(Q.month_sketches(frame(spark, []))).first()
    assert none["rows"] == 0 and none["distinct_invoices"] == 0
    assert Q.cardinalities(frame(spark, [])).first()["rows"] == 0


def test_bitmask_retention_equals_cohort_rows(spark, study):
    """By shifts, by window and by the line grain; also for a window of more months than a mask holds."""
    lines = study.with_customer
    for p in (study.params, study.params.with_(window_start="1992-01-01 00:00:00", window_end="1998-12-31 23:59:59")):
        some = lines if p is study.params else CL.with_customer(CL.clean_line_items(study.raw, p))
        want = rows(H.retention_long(H.with_cohort(H.active_months(some)), p))
        assert rows(H.retention_by_bits(H.month_masks(some, p), p)) == want
        assert rows(H.retention_by_bits(H.month_masks(CU.line_grain(some), p), p)) == want


def test_log_counts_from_the_grain(study):
    want = CL.line_counts(study.clean, study.params).first()
    assert CL.grain_counts(CU.line_grain(study.clean), study.params).first() == want
