"""Column expressions (P1-P20). All are built-in Spark expressions (codegen, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import AnalysisParams
from ..sources.schema import MONEY_TYPE, PRICE_TYPE


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def line_revenue(quantity="Quantity", unit_price="UnitPrice") -> Column:
    """Signed net line revenue, exact in decimal (six places for each factor)."""
    return (col_(quantity).cast(PRICE_TYPE) * col_(unit_price).cast(PRICE_TYPE)).cast(MONEY_TYPE)


def is_cancellation(params: AnalysisParams, invoice="InvoiceNo", quantity="Quantity") -> Column:
    """Invoice starts with the cancellation prefix OR quantity is negative."""
    return col_(invoice).cast("string").startswith(params.cancel_prefix) | (col_(quantity) < 0)


def month_start(ts="InvoiceDate") -> Column:
    """First instant of the month as ``timestamp_ntz`` (time-zone free)."""
    return F.trunc(col_(ts).cast("date"), "month").cast("timestamp_ntz")


def month_label(ts="InvoiceDate") -> Column:
    """``yyyy-MM`` label."""
    return F.date_format(col_(ts), "yyyy-MM")


def month_index(ts) -> Column:
    """Months since year 0 (``year*12 + month - 1``); differences give P11."""
    c = col_(ts)
    return F.year(c) * 12 + F.month(c) - 1


def months_between_starts(later, earlier) -> Column:
    """Whole months between two month buckets."""
    return month_index(later) - month_index(earlier)


def as_text(c) -> Column:
    """P5."""
    return col_(c).cast("string")


def is_non_product(params: AnalysisParams, stock_code="StockCode") -> Column:
    """Fee / postage / gift stock codes (audited, never removed)."""
    up = F.upper(as_text(stock_code))
    return up.isin(*params.non_product_codes) | up.startswith(params.non_product_prefix)


def clip_lower(c, lo) -> Column:
    """P7."""
    return F.greatest(col_(c), F.lit(lo))


def clip_upper(c, hi) -> Column:
    """P7."""
    return F.least(col_(c), F.lit(hi))


def round_half_even(c, places: int) -> Column:
    """banker's rounding, as pandas/numpy round floats."""
    return F.bround(col_(c), places)


def whole_days(start, end) -> Column:
    """Floor of elapsed 24-hour units; ``datediff`` would count calendar days."""
    return F.timestamp_diff("DAY", col_(start), col_(end))


def home_flag(params: AnalysisParams, country="Country") -> Column:
    """P10."""
    return (col_(country) == F.lit(params.home_country)).cast("int")


def ntz_literal(value) -> Column:
    """A ``timestamp_ntz`` literal from text: independent of any session time zone
    (a Python datetime literal would be a zoned timestamp)."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")


def snapshot(params: AnalysisParams) -> Column:
    """Midnight after the window end."""
    return ntz_literal(params.snapshot_ts)


def window_start(params: AnalysisParams) -> Column:
    return ntz_literal(params.start_ts)


def window_end(params: AnalysisParams) -> Column:
    return ntz_literal(params.end_ts)


def basket_size(total_quantity="TotalQuantity", frequency="Frequency") -> Column:
    """round(TotalQuantity / max(Frequency, 1), 2)."""
    return round_half_even(col_(total_quantity).cast("double") / clip_lower(frequency, 1), 2)


def avg_unit_price(monetary="Monetary", total_quantity="TotalQuantity") -> Column:
    """round(max(Monetary, 0) / max(TotalQuantity, 1), 3)."""
    return round_half_even(
        clip_lower(col_(monetary).cast("double"), 0.0) / clip_lower(col_(total_quantity).cast("double"), 1.0), 3
    )


def percent_of(part, whole) -> Column:
    """Part / whole * 100 in double."""
    return col_(part).cast("double") / col_(whole).cast("double") * F.lit(100.0)
