"""Headline KPIs (K1) and guard rails (V2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import AnalysisParams


def headline_kpis(grain: DataFrame, scored: DataFrame, params: AnalysisParams) -> DataFrame:
    """K1 in one-row aggregates stacked by a union (no join).

    ``grain`` is the line grain of the cleaned lines, null customers included.
    Revenue is over all of them; customers and invoices over attributed rows; AOV is net
    attributed revenue over non-cancelled attributed invoices (an invoice number counts
    once); repeat rate over net-positive customers.
    """
    has_cust = F.col("CustomerID").isNotNull()
    line = grain.agg(
        F.sum("revenue").alias("_rev_all"),
        F.sum(F.when(has_cust, F.col("revenue"))).alias("_rev_cust"),
    )
    customers = grain.where(has_cust).groupBy("CustomerID").agg(F.lit(1).alias("one"))
    customers = customers.agg(F.count(F.lit(1)).alias("total_customers"))
    numbers = grain.where(has_cust & (F.col("lines") > F.col("cancelled_lines")) & F.col("InvoiceNo").isNotNull())
    numbers = numbers.groupBy("InvoiceNo").agg(F.lit(1).alias("one"))
    numbers = numbers.agg(F.count(F.lit(1)).alias("total_invoices_customer_attributed"))
    cust = scored.agg(
        F.count_if(F.col("Frequency") >= params.repeat_min_frequency).alias("repeat_customer_count"),
        F.count(F.lit(1)).alias("_n_net_positive"),
    )
    parts = [line, customers, numbers, cust]
    one = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    one = one.agg(*[F.max(c).alias(c) for p in parts for c in p.columns])
    return one.select(
        F.col("_rev_all").cast("double").alias("total_revenue_gbp"),
        F.col("_rev_cust").cast("double").alias("total_revenue_customer_attributed_gbp"),
        (F.col("_rev_cust").cast("double") / F.col("total_invoices_customer_attributed")).alias("aov_gbp"),
        "total_customers",
        "total_invoices_customer_attributed",
        (F.col("repeat_customer_count") / F.col("_n_net_positive")).alias("repeat_purchase_rate"),
        "repeat_customer_count",
    )


def _check(label: str, value, lo, hi) -> F.Column:
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (value >= F.lit(lo))
    if hi is not None:
        ok = ok & (value <= F.lit(hi))
    return F.struct(
        F.lit(label).alias("check_name"),
        value.cast("double").alias("value"),
        F.lit(lo).cast("double").alias("lower"),
        F.lit(hi).cast("double").alias("upper"),
        ok.alias("passed"),
    )


def kpi_guard_rails(kpis: DataFrame, top: DataFrame, params: AnalysisParams) -> DataFrame:
    """V2: four range checks with PASS/REVIEW and an overall verdict; a null value is no pass.

    ``kpis`` and ``top`` are one-row frames; they are combined with a union + max.
    """
    one = (
        kpis.select("total_revenue_gbp", "total_customers", "repeat_purchase_rate")
        .unionByName(top.select(F.col("Revenue_share").alias("top_share")), allowMissingColumns=True)
        .agg(
            F.max("total_revenue_gbp").alias("rev"),
            F.max("total_customers").alias("cust"),
            F.max("repeat_purchase_rate").alias("rep"),
            F.max("top_share").alias("top"),
        )
    )
    top_ok = F.struct(
        F.lit("top_segment_share_pct").alias("check_name"),
        F.col("top").cast("double").alias("value"),
        F.lit(params.guard_top_share_min).cast("double").alias("lower"),
        F.lit(None).cast("double").alias("upper"),
        (F.col("top") > F.lit(params.guard_top_share_min)).alias("passed"),
    )
    checks = one.select(
        F.inline(
            F.array(
                _check("total_revenue_gbp", F.col("rev"), *params.guard_revenue),
                _check("total_customers", F.col("cust"), *params.guard_customers),
                _check("repeat_purchase_rate", F.col("rep"), *params.guard_repeat_rate),
                top_ok,
            )
        )
    )
    return checks.select(
        "check_name",
        "value",
        "lower",
        "upper",
        F.when(F.col("passed"), "PASS").otherwise("REVIEW").alias("status"),
        F.when(F.bool_and(F.coalesce("passed", F.lit(False))).over(Window.partitionBy()), "PASS").otherwise("REVIEW").alias("verdict"),
    )
