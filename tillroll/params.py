"""Analysis parameters, one frozen dataclass passed to every operator."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

# Fixed values that must equal the reference's for matching results.
REFERENCE_WINDOW_START = "2010-12-01 00:00:00"
REFERENCE_WINDOW_END = "2011-11-30 23:59:59"
REFERENCE_HOME_COUNTRY = "United Kingdom"
REFERENCE_NON_PRODUCT_CODES = ("POST", "M", "DOT", "BANK CHARGES", "AMAZONFEE", "CRUK", "B", "S")
REFERENCE_NON_PRODUCT_PREFIX = "GIFT_"
REFERENCE_TARGET_SEGMENTS = ("At Risk", "Cannot Lose Them", "About to Sleep")
REFERENCE_LTV_FEATURES = (
    "Recency",
    "Frequency",
    "Tenure_days",
    "AvgBasketSize",
    "AvgUnitPrice",
    "DistinctStockCodes",
    "UK_vs_International",
    "CancellationRate",
)
REFERENCE_RFM_FEATURES = ("Recency", "Frequency")


#: The rule that stands in for a model where its metrics are checked: so many invoices.
RULE_MIN_INVOICES = 2


def _parse_ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


@dataclass(frozen=True)
class AnalysisParams:
    """Every tunable of the analysis; defaults are the reference's values."""

    window_start: str = REFERENCE_WINDOW_START
    window_end: str = REFERENCE_WINDOW_END
    cancel_prefix: str = "C"
    non_product_codes: tuple[str, ...] = REFERENCE_NON_PRODUCT_CODES
    non_product_prefix: str = REFERENCE_NON_PRODUCT_PREFIX
    home_country: str = REFERENCE_HOME_COUNTRY
    n_bins: int = 5
    high_value_quantile: float = 0.80
    repeat_min_frequency: int = 2
    retention_windows: tuple[int, ...] = (1, 3, 6)
    target_segments: tuple[str, ...] = REFERENCE_TARGET_SEGMENTS
    top_countries_by_rows: int = 8
    top_countries_by_revenue: int = 10
    top_segments_shown: int = 6
    histogram_bins: int = 60
    invoice_total_clip: float = 2000.0
    # model
    ltv_features: tuple[str, ...] = REFERENCE_LTV_FEATURES
    rfm_features: tuple[str, ...] = REFERENCE_RFM_FEATURES
    n_folds: int = 5
    seed: int = 42
    test_share: float = 0.2
    n_repeats: int = 10
    pd_grid_resolution: int = 100
    pd_percentiles: tuple[float, float] = (0.05, 0.95)
    gbt_max_iter: int = 100
    gbt_max_leaves: int = 31
    gbt_step_size: float = 0.1
    gbt_max_bins: int = 255
    gbt_min_rows_per_leaf: int = 20
    gbt_l2: float = 0.0
    # above so many training rows a tenth validates, and no better loss in so many trees ends the fit
    gbt_early_stopping_rows: int = 10_000
    gbt_no_change: int = 10
    gbt_refresh: int = 10  # trees between two writes of the margins
    gbt_local_rows: int = 1 << 15  # a leaf of so many rows grows on from its rows
    customer_buckets: int = 16  # of published customer tables; on a cluster about bytes / 128 MB
    # guard rails (lower, upper); None = open
    guard_revenue: tuple[float | None, float | None] = (5_000_000.0, 15_000_000.0)
    guard_customers: tuple[float | None, float | None] = (3_000.0, 5_000.0)
    guard_repeat_rate: tuple[float | None, float | None] = (0.20, 0.80)
    guard_top_share_min: float = 0.0
    currency: str = "GBP"

    # derived values -------------------------------------------------------
    @property
    def start_ts(self) -> dt.datetime:
        return _parse_ts(self.window_start)

    @property
    def end_ts(self) -> dt.datetime:
        return _parse_ts(self.window_end)

    @property
    def snapshot_ts(self) -> dt.datetime:
        """Midnight after the window end."""
        end = self.end_ts
        return dt.datetime(end.year, end.month, end.day) + dt.timedelta(days=1)

    @property
    def first_month_index(self) -> int:
        s = self.start_ts
        return s.year * 12 + s.month - 1

    @property
    def last_observed_offset(self) -> int:
        """Month offset of the last month of the window (11 for 12 months)."""
        e = self.end_ts
        return e.year * 12 + e.month - 1 - self.first_month_index

    @property
    def n_periods(self) -> int:
        return self.last_observed_offset + 1

    def with_(self, **kw) -> "AnalysisParams":
        return replace(self, **kw)


def test_table_params() -> AnalysisParams:
    """Parameters for the line-item view derived from the driver's TPC-H-like tables."""
    return AnalysisParams(
        window_start="1997-01-01 00:00:00",
        window_end="1997-12-31 23:59:59",
        home_country="NATION_0",
    )
