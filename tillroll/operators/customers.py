"""Stage D: one feature row per customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..params import AnalysisParams

#: Keys of the line grain, the finest that a customer report asks for.
GRAIN_KEYS = ("CustomerID", "Country", "InvoiceNo", "StockCode", "InvMonth")
#: A customer's facets: the distinct values of each are counted or compared.
_INVOICE, _CODE, _COUNTRY = 0, 1, 2


def measured(df_clean: DataFrame) -> DataFrame:
    """Cleaned lines with the keys and the fixed-width measures of the line grain, a line per row."""
    cx = F.col("IsCancellation")
    quantity = df_clean.schema["Quantity"].dataType
    quantity = T.LongType() if isinstance(quantity, T.IntegralType) else quantity
    return df_clean.select(
        "CustomerID",
        "Country",
        "InvoiceNo",
        "StockCode",
        C.month_start("InvoiceDate").alias("InvMonth"),
        F.col("InvoiceDate").alias("first_line"),
        F.col("InvoiceDate").alias("last_line"),
        F.col("LineRevenue").alias("revenue"),
        F.lit(1).cast("long").alias("lines"),
        cx.cast("long").alias("cancelled_lines"),
        F.when(cx, F.lit(0).cast(quantity)).otherwise(F.col("Quantity").cast(quantity)).alias("quantity"),
    )


def line_grain(df_clean: DataFrame) -> DataFrame:
    """One row per (customer, country, invoice, stock code, month) with sums, minima and maxima.

    Customers, KPIs, cohorts and the counts of the cleaning log all follow from it. The
    null customer is a key like any other; a customer, or the null customer, with a third of
    all rows spreads over its invoices.
    """
    return measured(df_clean).groupBy(*GRAIN_KEYS).agg(*_totals())


def customer_facets(grain: DataFrame) -> DataFrame:
    """One row per (customer, facet, value): the measures of its invoices, stock codes and countries.

    Every row stands for itself under its invoice, its code and its country, and is combined
    before the only shuffle; a hot customer spreads over its values. Facets of disjoint sets
    of lines merge by one more aggregation over the same keys.
    """
    facets = F.array(
        *[
            F.struct(F.lit(k).alias("facet"), F.col(c).cast("string").alias("value"))
            for k, c in ((_INVOICE, "InvoiceNo"), (_CODE, "StockCode"), (_COUNTRY, "Country"))
        ]
    )
    rows = grain.where(F.col("CustomerID").isNotNull())
    return merge_facets(rows.select("CustomerID", F.inline(facets), *MEASURES))


def merge_facets(facets: DataFrame) -> DataFrame:
    return facets.groupBy("CustomerID", "facet", "value").agg(*_totals())


def customer_features(df_with_cust: DataFrame, params: AnalysisParams, grain: DataFrame | None = None) -> DataFrame:
    """C1-C10 from cleaned lines, or from a stored ``line_grain`` of them (the lines are the
    special case of a row per line). The source is read once."""
    return features_from_facets(customer_facets(measured(df_with_cust) if grain is None else grain), params)


def features_from_facets(facets: DataFrame, params: AnalysisParams) -> DataFrame:
    """One aggregation by customer over merged facets, no join."""
    of = lambda k, c: F.when(F.col("facet") == k, F.col(c))
    shopped = F.col("lines") > F.col("cancelled_lines")
    agg = facets.groupBy("CustomerID").agg(
        F.min("first_line").alias("first_invoice"),  # C2, cancellations included
        F.max("last_line").alias("last_invoice"),
        # C4: distinct invoices with a line that is not cancelled
        F.count_if((F.col("facet") == _INVOICE) & shopped).alias("Frequency"),
        F.sum(of(_INVOICE, "revenue")).alias("Monetary"),  # C5, net
        F.sum(of(_INVOICE, "quantity")).alias("TotalQuantity"),  # C6
        F.sum(of(_INVOICE, "lines")).alias("_lines"),
        F.sum(of(_INVOICE, "cancelled_lines")).alias("_cancelled"),
        # C7
        F.count_if((F.col("facet") == _CODE) & shopped & F.col("value").isNotNull()).alias("DistinctStockCodes"),
        # Ties go to the smallest name
        F.min(F.when(F.col("facet") == _COUNTRY, F.struct((-F.col("lines")).alias("n"), F.col("value").alias("c")))).alias("_mode"),
    )
    agg = agg.select(
        "CustomerID",
        "first_invoice",
        "last_invoice",
        "Frequency",
        "Monetary",
        "TotalQuantity",
        (F.col("_lines") - F.col("_cancelled")).alias("TotalLines"),
        "DistinctStockCodes",
        (F.col("_cancelled") / F.col("_lines")).alias("CancellationRate"),  # C8
        F.col("_mode.c").alias("Country"),
    )
    return agg.withColumns(
        {
            "Recency": C.whole_days("last_invoice", C.snapshot(params)),  # C3
            "Tenure_days": C.whole_days("first_invoice", "last_invoice"),  # P17
            "AvgBasketSize": C.basket_size(),  # P15
            "AvgUnitPrice": C.avg_unit_price(),  # P16
            "UK_vs_International": C.home_flag(params),  # P10
        }
    ).withColumns({"Recency": F.col("Recency").cast("bigint"), "Tenure_days": F.col("Tenure_days").cast("bigint")})


MEASURES = ("first_line", "last_line", "revenue", "lines", "cancelled_lines", "quantity")


def _totals() -> list[Column]:
    """The measures, combined once more."""
    return [
        F.min("first_line").alias("first_line"),
        F.max("last_line").alias("last_line"),
        *[F.sum(c).alias(c) for c in MEASURES[2:]],
    ]


def net_positive(features: DataFrame) -> DataFrame:
    """drop customers whose net Monetary is <= 0."""
    return features.where(F.col("Monetary") > 0)
