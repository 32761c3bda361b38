"""Fixed schemas and export column orders."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw line-item schema (typed, never inferred).
LINE_ITEM_SCHEMA = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType(), False),
        T.StructField("StockCode", T.StringType(), False),
        T.StructField("Description", T.StringType(), True),
        T.StructField("Quantity", T.LongType(), False),
        T.StructField("InvoiceDate", T.TimestampNTZType(), False),
        T.StructField("UnitPrice", T.DoubleType(), False),
        T.StructField("CustomerID", T.LongType(), True),
        T.StructField("Country", T.StringType(), False),
    ]
)

RAW_COLUMNS = [f.name for f in LINE_ITEM_SCHEMA.fields]

# Cleaned export, fixed order.
CLEAN_COLUMNS = RAW_COLUMNS + ["IsCancellation", "LineRevenue"]

# Customer export, fixed order.
CUSTOMER_COLUMNS = [
    "CustomerID",
    "Country",
    "UK_vs_International",
    "first_invoice",
    "last_invoice",
    "Tenure_days",
    "Recency",
    "Frequency",
    "Monetary",
    "TotalQuantity",
    "TotalLines",
    "DistinctStockCodes",
    "AvgBasketSize",
    "AvgUnitPrice",
    "CancellationRate",
    "R_score",
    "F_score",
    "M_score",
    "Segment",
]

# Exact money: line revenue and its sums stay decimal; reports convert to double last.
# Prices and quantities keep six places, so their product is exact at twelve.
MONEY_TYPE = T.DecimalType(28, 12)
PRICE_TYPE = T.DecimalType(16, 6)
