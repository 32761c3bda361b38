"""Segment analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import percent_of
from ..functions.segments import action_expr
from ..params import AnalysisParams


def segment_totals(scored: DataFrame) -> DataFrame:
    """Exact (decimal) revenue ``rev`` and customers per segment; at most 11 rows."""
    return scored.groupBy("Segment").agg(F.sum("Monetary").alias("rev"), F.count(F.lit(1)).alias("Customers"))


def segment_summary(scored: DataFrame) -> DataFrame:
    """K2 + K3: revenue and customers per segment, share of net-positive revenue.

    At most 11 groups leave the aggregation, so the share's window over all rows
    runs on 11 rows.
    """
    per = segment_totals(scored).withColumnRenamed("rev", "_rev")
    return per.select(
        "Segment",
        F.col("_rev").cast("double").alias("Revenue"),
        "Customers",
        percent_of("_rev", F.sum("_rev").over(Window.partitionBy())).alias("Revenue_share"),
    ).orderBy(F.desc("Revenue"), "Segment")


def top_segment(summary: DataFrame) -> DataFrame:
    """K4."""
    return summary.orderBy(F.desc("Revenue"), "Segment").limit(1)


def top_n_segments(summary: DataFrame, n: int = 6) -> DataFrame:
    """K5: top n with bar width relative to the largest share."""
    top = summary.orderBy(F.desc("Revenue"), "Segment").limit(n)
    return top.withColumn(
        "width_pct", F.col("Revenue_share") / F.max("Revenue_share").over(Window.partitionBy()) * 100.0
    ).orderBy(F.desc("Revenue"), "Segment")


def retention_targets(summary: DataFrame, params: AnalysisParams) -> DataFrame:
    """K6: the named target segments present in the data, in target order, with action."""
    order = F.array_position(F.array(*[F.lit(s) for s in params.target_segments]), F.col("Segment"))
    return (
        summary.where(F.col("Segment").isin(*params.target_segments))
        .withColumn("Action", action_expr())
        .withColumn("target_order", order.cast("int"))
        .orderBy("target_order")
    )


def target_pool(scored: DataFrame, params: AnalysisParams) -> DataFrame:
    """K7: the target segments together (sums kept in decimal, divided once)."""
    totals = segment_totals(scored)
    w_all = Window.partitionBy()
    return (
        totals.withColumn("_all", F.sum("rev").over(w_all))
        .where(F.col("Segment").isin(*params.target_segments))
        .agg(
            F.sum("Customers").alias("customers"),
            F.sum("rev").cast("double").alias("revenue"),
            percent_of(F.sum("rev"), F.first("_all")).alias("revenue_share_pct"),
            (F.sum("rev").cast("double") / F.sum("Customers")).alias("revenue_per_customer"),
        )
    )


def concentration(scored: DataFrame, top: int = 2) -> DataFrame:
    """K8: share of customers and of revenue held by the top segments."""
    w_all = Window.partitionBy()
    ranked = segment_totals(scored).select(
        "Segment",
        "rev",
        "Customers",
        F.sum("Customers").over(w_all).alias("_all_c"),
        F.sum("rev").over(w_all).alias("_all_r"),
        F.row_number().over(Window.orderBy(F.desc("rev"), "Segment")).alias("_pos"),
    )
    return ranked.where(F.col("_pos") <= top).agg(
        F.sum("Customers").alias("top_customers"),
        percent_of(F.sum("Customers"), F.first("_all_c")).alias("customer_share_pct"),
        percent_of(F.sum("rev"), F.first("_all_r")).alias("revenue_share_pct"),
    )
