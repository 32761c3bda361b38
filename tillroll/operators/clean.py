"""Stage C: trim, price filter, exact dedup, flags and the audited cleaning log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..params import AnalysisParams
from ..sources.schema import RAW_COLUMNS


def in_window(params: AnalysisParams, ts="InvoiceDate"):
    """F1 predicate, inclusive both ends."""
    return C.col_(ts).between(C.window_start(params), C.window_end(params))


def trim_window(df: DataFrame, params: AnalysisParams) -> DataFrame:
    """F1."""
    return df.where(in_window(params))


def drop_non_positive_price(df: DataFrame) -> DataFrame:
    """F2."""
    return df.where(F.col("UnitPrice") > 0)


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """exact duplicates over the eight raw columns.

    The shuffle hashes all eight columns, so a hot customer or the null-customer rows
    spread over every partition (hashing by CustomerID alone would put them in one task).
    """
    return df.select(*RAW_COLUMNS).dropDuplicates()


def add_flags(df: DataFrame, params: AnalysisParams) -> DataFrame:
    """P1 + P2: IsCancellation and exact LineRevenue."""
    return df.withColumns(
        {"IsCancellation": C.is_cancellation(params), "LineRevenue": C.line_revenue()}
    )


def clean_line_items(raw: DataFrame, params: AnalysisParams) -> DataFrame:
    """``df_c``: trimmed, priced, deduplicated, flagged; rows with no customer kept."""
    return add_flags(drop_exact_duplicates(drop_non_positive_price(trim_window(raw, params))), params)


def with_customer(df_clean: DataFrame) -> DataFrame:
    """customer-attributed rows (``df_with_cust``)."""
    return df_clean.where(F.col("CustomerID").isNotNull())


def non_cancelled(df: DataFrame) -> DataFrame:
    """F7."""
    return df.where(~F.col("IsCancellation"))


#: The texts of the audit's note column (a count with thousands separators goes in front of two of them).
NOTES = {
    "04_flag_cancellations": " kept and netted (per spec)",
    "05_drop_missing_customer": "for customer-level analyses",
    "06_non_product_codes": " fee/postage/gift rows kept (no product-level analysis in scope)",
    "07_drop_net_negative_customers": "customers with net Monetary <= 0 after netting cancellations",
}


def _fmt_int(c):
    return F.format_number(C.col_(c), 0)


def line_counts(df_clean: DataFrame, params: AnalysisParams) -> DataFrame:
    """The log's counts over cleaned lines, one row."""
    return df_clean.agg(
        F.count(F.lit(1)).alias("n_clean"),
        F.count_if(F.col("IsCancellation")).alias("n_cancel"),
        F.count_if(F.col("CustomerID").isNotNull()).alias("n_cust_rows"),
        F.count_if(C.is_non_product(params)).alias("n_nonprod"),
    )


def grain_counts(grain: DataFrame, params: AnalysisParams) -> DataFrame:
    """The same counts from a stored line grain, whose keys hold the customer and the stock code."""
    lines = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("lines"))), F.lit(0))
    return grain.agg(
        lines(F.lit(True)).alias("n_clean"),
        F.coalesce(F.sum("cancelled_lines"), F.lit(0)).alias("n_cancel"),
        lines(F.col("CustomerID").isNotNull()).alias("n_cust_rows"),
        lines(C.is_non_product(params)).alias("n_nonprod"),
    )


def cleaning_log(raw: DataFrame, clean_counts: DataFrame, features: DataFrame, params: AnalysisParams) -> DataFrame:
    """Q12: seven audited steps (step, rows_before, rows_after, note).

    Three one-row aggregates stacked by a union, never joined: over the raw view (steps 1-2
    by cumulative ``count_if``), the counts of ``line_counts`` or ``grain_counts`` (steps
    3-6), the customer features (step 7).
    """
    raw_counts = raw.agg(
        F.count(F.lit(1)).alias("n_raw"),
        F.count_if(in_window(params)).alias("n_window"),
        F.count_if(in_window(params) & (F.col("UnitPrice") > 0)).alias("n_priced"),
    )
    cust_counts = features.agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.count_if(F.col("Monetary") > 0).alias("n_net_positive"),
    )
    one = (
        raw_counts.unionByName(clean_counts, allowMissingColumns=True)
        .unionByName(cust_counts, allowMissingColumns=True)
        .agg(*[F.max(c).alias(c) for c in raw_counts.columns + clean_counts.columns + cust_counts.columns])
    )
    window_note = f"{params.start_ts.date()} → {params.end_ts.date()}"
    counted = {"04_flag_cancellations": "n_cancel", "06_non_product_codes": "n_nonprod"}
    steps = [
        ("01_trim_period", "n_raw", "n_window"),
        ("02_drop_unitprice_le_0", "n_window", "n_priced"),
        ("03_drop_exact_duplicates", "n_priced", "n_clean"),
        ("04_flag_cancellations", "n_clean", "n_clean"),
        ("05_drop_missing_customer", "n_clean", "n_cust_rows"),
        ("06_non_product_codes", "n_clean", "n_clean"),
        ("07_drop_net_negative_customers", "n_customers", "n_net_positive"),
    ]

    def note(step: str) -> Column:
        text = F.lit(window_note if step == "01_trim_period" else NOTES.get(step, ""))
        return F.concat(_fmt_int(counted[step]), text) if step in counted else text

    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("step"),
                F.col(b).cast("bigint").alias("rows_before"),
                F.col(a).cast("bigint").alias("rows_after"),
                note(name).alias("note"),
            )
            for name, b, a in steps
        ]
    )
    return one.select(F.inline(rows))


def non_product_audit(df_clean: DataFrame, params: AnalysisParams) -> DataFrame:
    """Q13: rows with fee / postage / gift codes (kept, only counted)."""
    return df_clean.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(C.is_non_product(params)).alias("non_product_rows"),
    )
