"""Expected values of the derived line-item view at sf0.01 (probed in Spark and DuckDB)."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF01
from tillroll.operators import clean as CL
from tillroll.operators import cohorts as H
from tillroll.plans.analysis import RetailAnalysis


@pytest.fixture(scope="module")
def a(spark):
    an = RetailAnalysis.from_test_tables(spark, SF01)
    yield an
    an.close()


def test_view_and_window_counts(a):
    w = a.raw.where(CL.in_window(a.params))
    assert a.raw.count() == 61223
    c = w.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("UnitPrice") <= 0).alias("price"),
        F.count_if(F.col("CustomerID").isNull()).alias("nocust"),
        F.count_if(F.col("InvoiceNo").startswith("C")).alias("c"),
    ).first()
    assert (c["n"], c["price"], c["nocust"], c["c"]) == (9285, 34, 1849, 196)
    assert a.clean.count() == 9047


def test_customers_and_segments(a):
    assert a.features.count() == 1056
    assert a.scored.count() == 1051
    got = {r["Segment"]: r["count"] for r in a.scored.groupBy("Segment").count().collect()}
    assert got == {
        "Lost": 264,
        "Hibernating": 215,
        "Loyal Customers": 186,
        "Champions": 99,
        "Potential Loyalists": 98,
        "Need Attention": 71,
        "At Risk": 52,
        "About to Sleep": 26,
        "Cannot Lose Them": 22,
        "Promising": 18,
    }


def test_cohorts(a):
    long = a.retention_long()
    sizes = long.where("period_n = 0").agg(F.count(F.lit(1)), F.sum("cohort_size")).first()
    assert tuple(sizes) == (12, 1056)
    assert long.where(F.col("observed") & (F.col("retained") > 0)).count() == 78
    m1 = {r["cohort_month"]: (r["retained"], r["cohort_size"]) for r in long.where("period_n = 1").collect()}
    assert m1["1997-01"] == (18, 141)
    assert m1["1997-11"] == (3, 46)


def test_invariants(a):
    seg = a.segment_summary.collect()
    assert sum(r["Customers"] for r in seg) == a.scored.count()
    assert abs(sum(r["Revenue_share"] for r in seg) - 100.0) < 1e-9
    long = a.retention_long()
    assert long.where("period_n = 0 AND retained != cohort_size").count() == 0
    log = a.cleaning_log().orderBy("step").collect()
    for prev, cur in zip(log, log[1:]):
        if cur["step"].startswith("07"):
            break
        if cur["step"].startswith("06"):
            assert cur["rows_before"] == log[3]["rows_after"]
            continue
        assert cur["rows_before"] == prev["rows_after"], cur["step"]
    from tillroll.operators import profile as Q

    pvr = Q.purchases_vs_returns(a.raw, a.params).fillna(0.0)
    net = Q.monthly_net_revenue(a.raw)
    bad = pvr.join(net, "month").where(F.abs(F.col("purchases") + F.col("returns") - F.col("revenue")) > 1e-6)
    assert bad.count() == 0
    bw = H.best_worst_m1(long).first()
    assert bw["n_cohorts"] == 12
