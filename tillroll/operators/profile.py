"""Stages A and B: profile and data-quality tables over the raw line items (Q1-Q11).

The charts are not drawn; each function returns the table behind one. Reports that need no
single line take the raw lines or their ``invoice_month_grain``, which a profile of several
reports stores once.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..params import AnalysisParams
from ..session import reliable_checkpoint
from ..sources.schema import RAW_COLUMNS


#: Measures of the invoice grain that add up; the null counts follow the raw columns.
_SUMS = ("_rows", "_revenue", "_purchases", "_returns", *[f"_null{i}" for i in range(len(RAW_COLUMNS))])


def _measured(raw: DataFrame, params: AnalysisParams | None = None) -> DataFrame:
    """Raw lines with the columns of ``invoice_month_grain``, a line per row; a grain stays as it is."""
    if "_rows" in raw.columns:
        return raw
    cx = C.is_cancellation(params or AnalysisParams())
    return with_raw_revenue(raw).select(
        "InvoiceNo",
        "Country",
        C.month_start("InvoiceDate").alias("_m"),
        F.col("InvoiceDate").alias("_first"),
        F.col("InvoiceDate").alias("_last"),
        F.lit(1).cast("long").alias("_rows"),
        F.col("LineRevenue").alias("_revenue"),
        F.when(~cx, F.col("LineRevenue")).alias("_purchases"),
        F.when(cx, F.col("LineRevenue")).alias("_returns"),
        *[F.col(c).isNull().cast("long").alias(f"_null{i}") for i, c in enumerate(RAW_COLUMNS)],
    )


def invoice_month_grain(raw: DataFrame, params: AnalysisParams) -> DataFrame:
    """One row per (invoice, country, month): rows, money, dates and nulls of its lines.

    Most profile tables follow from it, so they share one read of the raw lines. A line
    without an invoice number, country or date is grouped under null.
    """
    return _measured(raw, params).groupBy("InvoiceNo", "Country", "_m").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), *[F.sum(c).alias(c) for c in _SUMS]
    )


def rows_per_month(raw: DataFrame) -> DataFrame:
    """Q1."""
    per = _measured(raw).groupBy("_m").agg(F.sum("_rows").alias("rows"))
    return _month_named(per, "rows")


def _month_named(per: DataFrame, *columns: str) -> DataFrame:
    """Rows keyed by the month's first day ``_m``, with the label in its place (formatted once per month)."""
    return per.select(C.month_label("_m").alias("month"), *columns).orderBy("month")


def top_countries_by_rows(raw: DataFrame, n: int = 8) -> DataFrame:
    """Q2: top-k (a ``TakeOrderedAndProject``: per-partition top n, then merge)."""
    per = _measured(raw).groupBy("Country").agg(F.sum("_rows").alias("rows"))
    return per.orderBy(F.desc("rows"), "Country").limit(n)


def cardinalities(raw: DataFrame, exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """Q3: rows, distinct invoices / stock codes / customers / countries, span in days.

    Exact counts come from one read: a row stands for its value in each of the four columns,
    and equal values are combined before the only shuffle. ``exact=False`` uses HyperLogLog++
    sketches (relative error ``rsd``), one pass and a fixed-size buffer per task.
    """
    order = ["rows", *CARDINALITIES, "span_days"]
    span = lambda first, last: C.whole_days(F.min(first), F.max(last)).cast("bigint").alias("span_days")
    if not exact:
        return raw.agg(
            F.count(F.lit(1)).alias("rows"),
            span("InvoiceDate", "InvoiceDate"),
            *[F.approx_count_distinct(c, rsd).alias(k) for k, c in CARDINALITIES.items()],
        ).select(*order)
    named = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"))
            for k, c in enumerate(CARDINALITIES.values())
        ]
    )
    values = (
        raw.select("InvoiceDate", F.inline(named))
        .groupBy("kind", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("InvoiceDate").alias("first"), F.max("InvoiceDate").alias("last"))
    )
    return values.agg(
        F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.lit(0)).alias("rows"),
        span("first", "last"),
        *[F.count_if((F.col("kind") == k) & F.col("value").isNotNull()).alias(c) for k, c in enumerate(CARDINALITIES)],
    ).select(*order)


#: Q3's distinct counts and their columns.
CARDINALITIES = {
    "distinct_invoices": "InvoiceNo",
    "distinct_stock_codes": "StockCode",
    "distinct_customers": "CustomerID",
    "countries": "Country",
}
#: 2^14 registers a sketch: a relative standard error of about 0.8 percent.
SKETCH_BITS = 14


def month_sketches(raw: DataFrame) -> DataFrame:
    """Per month: rows, first and last date and a mergeable distinct sketch of each Q3 column.

    A month's row never changes once its lines are in, so a stored table of these rows
    answers Q3 for any span of months without reading lines again.
    """
    sketch = lambda c: F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_BITS))
    return raw.groupBy(C.month_start("InvoiceDate").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("InvoiceDate").alias("first"),
        F.max("InvoiceDate").alias("last"),
        *[sketch(c).alias(k) for k, c in CARDINALITIES.items()],
    )


def cardinalities_from_sketches(sketches: DataFrame) -> DataFrame:
    """Q3 rolled up from ``month_sketches`` rows: exact rows and span, estimated distinct counts."""
    estimate = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).cast("bigint").alias(c)
    return sketches.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        *[estimate(c) for c in CARDINALITIES],
        C.whole_days(F.min("first"), F.max("last")).cast("bigint").alias("span_days"),
    )


def row_key(n_hashes: int = 3) -> list[Column]:
    """A line by 64-bit hashes of its eight columns, each from a seed of its own.

    Three of them make 192 bits: among 10^13 lines, two that differ share all three with a
    probability below 10^-31.
    """
    return [F.xxhash64(F.lit(k), *map(F.col, RAW_COLUMNS)).alias(f"_h{k}") for k in range(n_hashes)]


def quality_flags(raw: DataFrame, params: AnalysisParams) -> DataFrame:
    """Q4 + F11 in one shuffle that carries hashes in place of the lines.

    Every flag is a function of the row, so it is constant inside a group of exact copies;
    the group count gives both the row count and the duplicate excess. Copies meet by
    ``row_key`` and a line's five flags travel as the bits of one number.
    """
    flags = {
        "cancellations": C.as_text("InvoiceNo").startswith(params.cancel_prefix),
        "non_positive_quantity": F.col("Quantity") <= 0,
        "non_positive_price": F.col("UnitPrice") <= 0,
        "missing_customer": F.col("CustomerID").isNull(),
    }
    bits = reduce(Column.bitwiseOR, [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(flags.values())])
    keyed = raw.select(*row_key(), bits.alias("_bits"))
    groups = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("_n"))
    weighted = lambda k: F.sum(F.when(F.col("_bits").bitwiseAND(F.lit(1 << k)) != 0, F.col("_n")).otherwise(0))
    return groups.agg(
        F.sum("_n").cast("bigint").alias("rows"),
        *[weighted(k).cast("bigint").alias(name) for k, name in enumerate(flags)],
        F.sum(F.col("_n") - 1).cast("bigint").alias("exact_duplicates"),
    )


def null_profile(raw: DataFrame) -> DataFrame:
    """Q5: nulls and percent per column, ascending (ties in column order)."""
    cols = RAW_COLUMNS
    counts = _measured(raw).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("_rows"),
        *[F.coalesce(F.sum(f"_null{i}"), F.lit(0)).alias(f"_n{i}") for i in range(len(cols))],
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("column_order"), F.col(f"_n{i}").alias("null_count"))
            for i, c in enumerate(cols)
        ]
    )
    return (
        counts.select("_rows", F.inline(entries))
        .select(
            "column_name",
            "column_order",
            F.col("null_count").cast("bigint").alias("null_count"),
            C.percent_of("null_count", "_rows").alias("null_pct"),
        )
        .orderBy("null_count", "column_order")
    )


def date_range(raw: DataFrame) -> DataFrame:
    """Q6."""
    return _measured(raw).agg(F.min("_first").alias("first_invoice"), F.max("_last").alias("last_invoice"))


def with_raw_revenue(raw: DataFrame) -> DataFrame:
    return raw.withColumn("LineRevenue", C.line_revenue())


def monthly_net_revenue(raw: DataFrame) -> DataFrame:
    """Q7: net revenue per month (GBP; divide by 1e6 for the chart's millions)."""
    per = _measured(raw).groupBy("_m").agg(F.sum("_revenue").cast("double").alias("revenue"))
    return _month_named(per, "revenue")


def country_revenue(raw: DataFrame, n: int = 10) -> DataFrame:
    """Q8: top countries by revenue with their row count, one aggregation."""
    return (
        _measured(raw)
        .groupBy("Country")
        .agg(F.sum("_revenue").alias("_rev"), F.sum("_rows").alias("rows"))
        .select("Country", F.col("_rev").cast("double").alias("revenue"), "rows")
        .orderBy(F.desc("revenue"), "Country")
        .limit(n)
    )


def invoice_sizes(raw: DataFrame, positive_only: bool = True) -> DataFrame:
    """Q10 (+F5): lines and net total per invoice; by default invoices with total > 0.

    Partial aggregation before the shuffle; a hot invoice costs one row per map task.
    """
    inv = (
        _measured(raw)
        .groupBy("InvoiceNo")
        .agg(F.sum("_rows").alias("Lines"), F.sum("_revenue").alias("_total"))
        .select("InvoiceNo", "Lines", F.col("_total").cast("double").alias("Total"))
    )
    return inv.where(F.col("Total") > 0) if positive_only else inv


def histogram(df: DataFrame, value_col: str, bins: int = 60) -> DataFrame:
    """Q9: equal-width histogram on [min, max], last bin closed, all bins listed.

    One plan over one aggregate, the rows per value: its range is a scalar subquery over
    the same exchange, so the source is read once. Without values there is no row.
    """
    v = F.col(value_col).cast("double")
    values = df.where(v.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(
        F.when(F.col("lo") == F.col("hi"), F.struct((F.col("lo") - 0.5).alias("lo"), (F.col("hi") + 0.5).alias("hi")))
        .otherwise(F.struct("lo", "hi"))
        .alias("r")
    )
    placed = values.withColumn("r", ends.scalar())
    scaled = (F.col("v") - F.col("r.lo")) * F.lit(float(bins)) / (F.col("r.hi") - F.col("r.lo"))
    counts = placed.groupBy(F.least(F.floor(scaled).cast("int"), F.lit(bins - 1)).alias("bin")).agg(
        F.sum("n").alias("n"), F.max("r").alias("r")
    )
    # at most `bins` entries: fold them into one map and list every bin, no grid join
    folded = counts.agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.max("r").alias("r"))
    lower, width = F.col("r.lo"), (F.col("r.hi") - F.col("r.lo")) / F.lit(float(bins))
    return (
        folded.where(F.col("r").isNotNull())
        .select("m", "r", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .select(
            F.col("bin").cast("int").alias("bin"),
            (lower + F.col("bin") * width).alias("lower"),
            (lower + (F.col("bin") + 1) * width).alias("upper"),
            F.coalesce(F.element_at("m", F.col("bin")), F.lit(0)).cast("bigint").alias("count"),
        )
        .orderBy("bin")
    )


def quantity_histogram(raw: DataFrame, bins: int = 60) -> DataFrame:
    """Q9 on positive quantities."""
    return histogram(raw.where(F.col("Quantity") > 0), "Quantity", bins)


def unit_price_histogram(raw: DataFrame, bins: int = 60) -> DataFrame:
    """Q9 on positive unit prices."""
    return histogram(raw.where(F.col("UnitPrice") > 0), "UnitPrice", bins)


def invoice_lines_histogram(raw: DataFrame, bins: int = 60) -> DataFrame:
    """Q9 on lines per positive-total invoice."""
    return histogram(invoice_sizes(raw), "Lines", bins)


def invoice_total_histogram(raw: DataFrame, bins: int = 60, clip: float = 2000.0) -> DataFrame:
    """Q9 on positive invoice totals clipped at ``clip``."""
    inv = invoice_sizes(raw).withColumn("TotalClipped", C.clip_upper("Total", clip))
    return histogram(inv, "TotalClipped", bins)


def purchases_vs_returns(raw: DataFrame, params: AnalysisParams) -> DataFrame:
    """Q11: purchases and returns per month; null where a side has no row that month."""
    per = (
        _measured(raw, params)
        .groupBy("_m")
        .agg(*[F.sum(f"_{side}").cast("double").alias(side) for side in ("purchases", "returns")])
    )
    return _month_named(per, "purchases", "returns")


def line_features(df_clean: DataFrame, params: AnalysisParams) -> DataFrame:
    """The scalar columns every analysis derives from a cleaned line."""
    return df_clean.select(
        "InvoiceNo",
        "StockCode",
        "InvoiceDate",
        "CustomerID",
        C.month_start("InvoiceDate").alias("invoice_month"),
        C.month_label("InvoiceDate").alias("month_label"),
        "IsCancellation",
        F.col("LineRevenue").cast("double").alias("line_revenue"),
        C.is_non_product(params).alias("is_non_product"),
        C.home_flag(params).alias("is_home"),
        C.months_between_starts("InvoiceDate", C.window_start(params)).alias("month_offset"),
    )


class Profile:
    """The profile tables of one raw frame; those without single lines share one stored grain."""

    def __init__(self, raw: DataFrame, params: AnalysisParams):
        self.raw = raw
        self.params = params

    @cached_property
    def grain(self) -> DataFrame:
        return reliable_checkpoint(invoice_month_grain(self.raw, self.params))

    def tables(self) -> dict[str, DataFrame]:
        p, grain = self.params, self.grain
        return {
            "rows_per_month": rows_per_month(grain),
            "top_countries_by_rows": top_countries_by_rows(grain, p.top_countries_by_rows),
            "cardinalities": cardinalities(self.raw),
            "quality_flags": quality_flags(self.raw, p),
            "null_profile": null_profile(grain),
            "date_range": date_range(grain),
            "monthly_net_revenue": monthly_net_revenue(grain),
            "country_revenue": country_revenue(grain, p.top_countries_by_revenue),
            "invoice_sizes": invoice_sizes(grain),
            "purchases_vs_returns": purchases_vs_returns(grain, p),
        }
