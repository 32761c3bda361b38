"""Hand-made rows for the semantics that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import frame, line
from tillroll.operators import clean as CL
from tillroll.operators import cohorts as H
from tillroll.operators import customers as CU
from tillroll.operators import ltv as M
from tillroll.operators import segments as S
from tillroll.params import AnalysisParams

P = AnalysisParams()  # reference window 2010-12-01 .. 2011-11-30, snapshot 2011-12-01


def features(spark, rows):
    df = CL.clean_line_items(frame(spark, rows), P)
    return CU.customer_features(CL.with_customer(df), P)


def test_country_tie_goes_to_smallest(spark):
    f = features(
        spark,
        [
            line("1", "A1", 1, "2011-05-01 10:00:00", 2.0, 7, "B"),
            line("2", "A1", 1, "2011-05-02 10:00:00", 2.0, 7, "A"),
        ],
    ).first()
    assert f["Country"] == "A"


def test_cancelled_only_customer(spark):
    rows = [line("C9", "A1", -1, "2011-05-01 10:00:00", 3.0, 9)]
    f = features(spark, rows)
    r = f.first()
    assert r["Frequency"] == 0 and r["TotalLines"] == 0 and r["TotalQuantity"] == 0
    assert r["CancellationRate"] == 1.0
    assert CU.net_positive(f).count() == 0


def test_sub_day_recency_is_zero(spark):
    r = features(spark, [line("1", "A1", 1, "2011-11-30 10:00:00", 2.0, 5)]).first()
    assert r["Recency"] == 0  # 14 hours before the snapshot midnight
    r = features(spark, [line("1", "A1", 1, "2011-11-29 23:00:00", 2.0, 5)]).first()
    assert r["Recency"] == 1


def test_duplicate_with_null_customer_keeps_one(spark):
    rows = [line("1", "A1", 1, "2011-05-01 10:00:00", 2.0, None)] * 2
    assert CL.clean_line_items(frame(spark, rows), P).count() == 1


def test_window_is_inclusive_and_price_filter(spark):
    rows = [
        line("1", "A1", 1, "2010-12-01 00:00:00", 2.0, 1),
        line("2", "A1", 1, "2011-11-30 23:59:59", 2.0, 1),
        line("3", "A1", 1, "2011-12-01 00:00:00", 2.0, 1),
        line("4", "A1", 1, "2011-05-01 00:00:00", 0.0, 1),
        line("5", "A1", 1, "2011-05-01 00:00:00", -1.0, 1),
    ]
    assert {r["InvoiceNo"] for r in CL.clean_line_items(frame(spark, rows), P).collect()} == {"1", "2"}


def test_negative_quantity_is_cancellation_and_revenue_is_net(spark):
    rows = [
        line("1", "A1", 3, "2011-05-01 10:00:00", 1.25, 1),
        line("2", "A1", -1, "2011-05-02 10:00:00", 1.25, 1),
    ]
    df = CL.clean_line_items(frame(spark, rows), P)
    got = {r["InvoiceNo"]: (r["IsCancellation"], float(r["LineRevenue"])) for r in df.collect()}
    assert got == {"1": (False, 3.75), "2": (True, -1.25)}
    f = CU.customer_features(CL.with_customer(df), P).first()
    assert float(f["Monetary"]) == 2.5 and f["Frequency"] == 1 and f["TotalQuantity"] == 3
    assert f["AvgBasketSize"] == 3.0 and f["AvgUnitPrice"] == 0.833


def test_basket_rounding_is_half_even(spark):
    from tillroll.functions.columns import round_half_even

    got = spark.range(1).select(
        round_half_even(F.lit(0.125), 2).alias("x"), round_half_even(F.lit(0.375), 2).alias("y")
    ).first()
    assert (got["x"], got["y"]) == (0.12, 0.38)


def _cohort_long(spark, rows):
    df = CL.clean_line_items(frame(spark, rows), P)
    return H.retention_long(H.with_cohort(H.active_months(CL.with_customer(df))), P)


def test_cohort_without_m1_activity_is_zero_and_unobserved_is_null(spark):
    rows = [
        # cohort 2011-10 (offset 10): active only in its first month; M+1 is observed
        line("1", "A1", 1, "2011-10-05 10:00:00", 2.0, 1),
        # cohort 2011-11 (offset 11): M+1 is beyond the window
        line("2", "A1", 1, "2011-11-05 10:00:00", 2.0, 2),
        # cancellations do not start a cohort
        line("C3", "A1", -1, "2011-09-05 10:00:00", 2.0, 1),
    ]
    long = {(r["cohort_month"], r["period_n"]): r for r in _cohort_long(spark, rows).collect()}
    assert set(m for m, _ in long) == {"2011-10", "2011-11"}
    assert long[("2011-10", 1)]["retention_pct"] == 0.0
    assert long[("2011-10", 1)]["observed"] is True
    assert long[("2011-11", 1)]["retention_pct"] is None
    assert long[("2011-11", 0)]["retention_pct"] == 100.0


def test_absent_target_segment_keeps_actions_by_name(spark):
    summary = spark.createDataFrame(
        [("Cannot Lose Them", 10.0, 1, 50.0), ("About to Sleep", 10.0, 1, 50.0)],
        "Segment string, Revenue double, Customers long, Revenue_share double",
    )
    got = {r["Segment"]: r["Action"] for r in S.retention_targets(summary, P).collect()}
    assert got["Cannot Lose Them"].startswith("VIP rescue")
    assert got["About to Sleep"].startswith("Awareness nudge")


def test_undefined_precision_is_zero(spark):
    pred = spark.createDataFrame([(1, 0), (0, 0)], "IsTopQuintileM int, prediction int")
    m = M.classification_metrics(pred).first()
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0)
    c = M.confusion_matrix(pred).first()
    assert [c["true0_pred0"], c["true0_pred1"], c["true1_pred0"], c["true1_pred1"]] == [1, 0, 1, 0]


def test_coinciding_recency_edges_raise(spark):
    from tillroll.operators.rfm import rfm_scores

    rows = [line(str(i), "A1", 1, "2011-11-01 10:00:00", 1.0 + i, i) for i in range(1, 8)]
    f = CU.net_positive(features(spark, rows))
    with pytest.raises(ValueError):
        rfm_scores(f, P)


def test_non_product_audit_counts_but_keeps(spark):
    rows = [
        line("1", "post", 1, "2011-05-01 10:00:00", 2.0, 1),
        line("2", "GIFT_0001_10", 1, "2011-05-01 10:00:00", 2.0, 1),
        line("3", "BANK CHARGES", 1, "2011-05-01 10:00:00", 2.0, 1),
        line("4", "85123A", 1, "2011-05-01 10:00:00", 2.0, 1),
    ]
    df = CL.clean_line_items(frame(spark, rows), P)
    r = CL.non_product_audit(df, P).first()
    assert (r["rows"], r["non_product_rows"]) == (4, 3)


def test_cardinalities_approx_close_to_exact(spark):
    from tillroll.operators import profile as Q

    rows = [line(str(i % 97), str(i % 31), 1, "2011-05-01 10:00:00", 2.0, i % 13, f"C{i % 5}") for i in range(2000)]
    df = frame(spark, rows)
    ex = Q.cardinalities(df).first()
    ap = Q.cardinalities(df, exact=False).first()
    assert (ex["distinct_invoices"], ex["distinct_stock_codes"], ex["distinct_customers"], ex["countries"]) == (97, 31, 13, 5)
    for k in ("distinct_invoices", "distinct_stock_codes", "distinct_customers", "countries"):
        assert abs(ap[k] - ex[k]) <= max(1, 0.05 * ex[k])


def test_results_do_not_depend_on_session_time_zone(spark):
    import __spark_entry__ as E
    from tests.conftest import SF001

    def run():
        return sorted(tuple(r) for r in E.queries()["cleaning_log"](spark, SF001).collect()) + sorted(
            tuple(r) for r in E.queries()["retention_cells"](spark, SF001).collect()
        )

    before = spark.conf.get("spark.sql.session.timeZone")
    base = run()
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        shifted = run()
        assert spark.conf.get("spark.sql.session.timeZone") == "America/Los_Angeles"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert shifted == base


def test_country_mode(spark):
    rows = [
        line("1", "A1", 1, "2011-05-01 10:00:00", 2.0, 7, "B"),
        line("2", "A1", 1, "2011-05-02 10:00:00", 2.0, 7, "A"),
        line("3", "A1", 1, "2011-05-03 10:00:00", 2.0, 8, "B"),
        line("4", "A1", 1, "2011-05-04 10:00:00", 2.0, 8, "B"),
        line("5", "A1", 1, "2011-05-05 10:00:00", 2.0, 8, "A"),
    ]
    df = CL.with_customer(CL.clean_line_items(frame(spark, rows), P))
    assert {r["CustomerID"]: r["Country"] for r in CU.customer_features(df, P).collect()} == {7: "A", 8: "B"}


def test_an_invoice_that_spans_countries_counts_once(spark):
    rows = [
        line("1", "A1", 1, "2011-05-01 10:00:00", 2.0, 7, "B"),
        line("1", "A2", 3, "2011-05-01 10:00:00", 2.0, 7, "A"),
        line("C2", "A2", -1, "2011-05-02 10:00:00", 2.0, 7, "A"),
    ]
    df = CL.clean_line_items(frame(spark, rows), P)
    r = CU.customer_features(df, P).first()
    assert (r["Frequency"], r["TotalLines"], r["DistinctStockCodes"], r["TotalQuantity"]) == (1, 2, 2, 4)
    again = CU.customer_features(df, P, CU.line_grain(df)).first()
    assert r == again


def test_prices_are_not_rounded_before_the_product(spark):
    df = CL.clean_line_items(frame(spark, [line("1", "A1", 1, "2011-05-01 10:00:00", 1.0015, 7)]), P)
    assert float(df.first()["LineRevenue"]) == 1.0015


def test_null_check_is_no_pass(spark):
    from tillroll.operators.kpis import kpi_guard_rails

    kpis = spark.createDataFrame(
        [(7e6, None, 0.5)], "total_revenue_gbp double, total_customers long, repeat_purchase_rate double"
    )
    top = spark.createDataFrame([(40.0,)], "Revenue_share double")
    rails = kpi_guard_rails(kpis, top, P).collect()
    assert {r["verdict"] for r in rails} == {"REVIEW"}
    assert {r["check_name"] for r in rails if r["status"] == "REVIEW"} == {"total_customers"}


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.5, 9.0, 10.0], [3.0], [-2.0, 0.1, 0.2, 0.30000000000000004, 7.7]])
def test_histogram_agrees_with_numpy(spark, values):
    import numpy as np

    from tillroll.operators.profile import histogram

    df = spark.createDataFrame([(v,) for v in [*values, *values, None]], "x double")
    got = histogram(df, "x", 7).collect()
    counts, edges = np.histogram(values * 2, bins=7)
    assert [r["count"] for r in got] == counts.tolist()
    assert np.allclose([r["lower"] for r in got] + [got[-1]["upper"]], edges)
    assert histogram(df.where("x > 100"), "x", 7).count() == 0
