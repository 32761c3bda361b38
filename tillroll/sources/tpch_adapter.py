"""Line-item view over the driver's TPC-H-like tables.

The real input is a retail line-item table (see ``schema.LINE_ITEM_SCHEMA``). The test
tables carry no cancellations, nulls or duplicates, so this adapter derives them with
fixed rules over lineitem ⋈ orders ⋈ customer ⋈ nation ⟕ part.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ntz_literal
from ..params import AnalysisParams

# Fixed values of the derivation rules.
CANCEL_RETURNFLAG = "R"
CANCEL_TAX = 0.08
FREE_DISCOUNT = 0.10
FREE_TAX = 0.0
POSTAGE_PARTKEY_MODULUS = 40
DUPLICATE_PARTKEY_MODULUS = 50
NO_DESCRIPTION_PARTKEY_MODULUS = 30
NO_CUSTOMER_PRIORITY = "5-LOW"


def unit_price_cents():
    """round(l_extendedprice / l_quantity, 2) in cents, half-up on the exact quotient.

    Rounding the double quotient depends on the engine (binary vs decimal view of
    x.xx5). Prices are whole cents and quantities whole units, so the exact rule is
    integer arithmetic: (2E + q) div 2q, with E the extended price in cents.
    """
    return F.expr(
        "(2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))"
        " div (2 * CAST(l_quantity AS BIGINT))"
    )


def _read(spark: SparkSession, sf_dir: str, name: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed read schemas of the driver's tables, limited to the columns the view uses.
# Declaring them skips the footer-reading job that schema inference starts for every
# table, and the scans read only these columns.
TABLE_SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, "
    "l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_nationkey INT",
    "nation": "n_nationkey INT, n_name STRING",
    "part": "p_partkey BIGINT, p_name STRING",
}


def read_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five source tables with fixed schemas (no inference job), each listed once."""
    return {name: _read(spark, sf_dir, name, ddl) for name, ddl in TABLE_SCHEMAS.items()}


def line_items(
    spark: SparkSession,
    sf_dir: str,
    params: AnalysisParams | None = None,
    tables: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """The raw line-item view (8 columns). With ``params`` the orders scan is pre-trimmed.

    ``InvoiceDate`` = ``o_orderdate`` + (0..23) hours, so the analysis window on
    ``InvoiceDate`` implies ``o_orderdate`` in [start - 1 day, end]. Passing ``params``
    adds that implied predicate, which Parquet can push into the orders scan
    (row-group skipping), and Spark's runtime bloom filter can carry to the lineitem
    scan. The rows inside the window are unchanged.
    """
    t = tables if tables is not None else read_tables(spark, sf_dir)
    li = t["lineitem"]
    orders = t["orders"]
    if params is not None:
        lo = params.start_ts - dt.timedelta(days=1)
        hi = params.end_ts
        orders = orders.where(
            (F.col("o_orderdate") >= ntz_literal(lo)) & (F.col("o_orderdate") <= ntz_literal(hi))
        )
    customer, nation, part = t["customer"], t["nation"], t["part"]

    # Joins are declared plainly: the planner broadcasts nation/customer only when
    # their measured size is under spark.sql.autoBroadcastJoinThreshold (AQE re-checks
    # at runtime) and otherwise uses a shuffled sort-merge join. Orders meet their customers
    # before the lines, which are several times as many.
    bought = orders.join(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    joined = li.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey"), "left"
    )
    cancelled: Column = (F.col("l_returnflag") == F.lit(CANCEL_RETURNFLAG)) & (F.col("l_tax") == F.lit(CANCEL_TAX))
    free = (F.col("l_discount") == F.lit(FREE_DISCOUNT)) & (F.col("l_tax") == F.lit(FREE_TAX))
    view = joined.select(
        F.concat(F.when(cancelled, F.lit("C")).otherwise(F.lit("")), F.col("o_orderkey").cast("string")).alias(
            "InvoiceNo"
        ),
        F.when(F.col("l_partkey") % POSTAGE_PARTKEY_MODULUS == 0, F.lit("POST"))
        .otherwise(F.col("l_partkey").cast("string"))
        .alias("StockCode"),
        F.when(F.col("l_partkey") % NO_DESCRIPTION_PARTKEY_MODULUS != 0, F.col("p_name")).alias("Description"),
        F.when(cancelled, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("Quantity"),
        F.expr("timestampadd(HOUR, o_orderkey % 24, o_orderdate)").alias("InvoiceDate"),
        F.when(free, F.lit(0.0)).otherwise(unit_price_cents() / F.lit(100.0)).alias("UnitPrice"),
        F.when(F.col("o_orderpriority") == F.lit(NO_CUSTOMER_PRIORITY), F.lit(None).cast("bigint"))
        .otherwise(F.col("o_custkey"))
        .alias("CustomerID"),
        F.col("n_name").alias("Country"),
        # exact copies: one extra row for the duplicate rule, made by a generator
        # instead of a self-union so the joins run once
        F.explode(
            F.when(F.col("l_partkey") % DUPLICATE_PARTKEY_MODULUS == 1, F.array(F.lit(0), F.lit(1))).otherwise(
                F.array(F.lit(0))
            )
        ).alias("_copy"),
    )
    return view.drop("_copy")
