"""Cohort retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..params import AnalysisParams


def active_months(df_with_cust: DataFrame) -> DataFrame:
    """H1: one row per (customer, month) with a non-cancelled line, with its line count.

    Partial aggregation before the shuffle; the output is bounded by customers x months.
    """
    return (
        df_with_cust.where(~F.col("IsCancellation") & F.col("CustomerID").isNotNull())
        .groupBy("CustomerID", C.month_start("InvoiceDate").alias("InvMonth"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )


def with_cohort(active: DataFrame) -> DataFrame:
    """H2 + H3: cohort = first active month; period = whole months since it.

    The window partition per customer holds at most one row per month of the window.
    """
    return active.withColumn(
        "CohortMonth", F.min("InvMonth").over(Window.partitionBy("CustomerID"))
    ).withColumn("PeriodN", C.months_between_starts("InvMonth", "CohortMonth"))


def cohort_sizes(cohorted: DataFrame) -> DataFrame:
    """H4: customers per cohort (each customer has exactly one row at period 0)."""
    return cohorted.where(F.col("PeriodN") == 0).groupBy("CohortMonth").agg(F.count(F.lit(1)).alias("cohort_size"))


def retained_counts(cohorted: DataFrame) -> DataFrame:
    """H5: retained customers per (cohort, period); rows are unique per customer-month."""
    return cohorted.groupBy("CohortMonth", "PeriodN").agg(F.count(F.lit(1)).alias("retained"))


def retention_long(cohorted: DataFrame, params: AnalysisParams) -> DataFrame:
    """H4-H8 in long form: every cohort x period 0..last, missing = 0, masked pct = null.

    One lineage, no join: the retained counts (H5, at most months^2 rows) are folded
    into one map per cohort, the cohort size (H4) is its period-0 cell (every customer
    is active in its own cohort month), and the dense grid comes from
    ``explode(sequence)``. ``observed`` uses the real month offset of the cohort from
    the window start, so a month with no cohort does not shift the mask.
    """
    per_cohort = retained_counts(cohorted).groupBy("CohortMonth").agg(
        F.map_from_entries(F.collect_list(F.struct("PeriodN", "retained"))).alias("_cells")
    )
    cells = per_cohort.select(
        "CohortMonth",
        F.element_at("_cells", F.lit(0)).alias("cohort_size"),
        "_cells",
        F.explode(F.sequence(F.lit(0), F.lit(params.last_observed_offset))).alias("PeriodN"),
    ).withColumn("retained", F.coalesce(F.element_at("_cells", F.col("PeriodN")), F.lit(0)))
    return _observed(cells, params)


def _observed(cells: DataFrame, params: AnalysisParams) -> DataFrame:
    """H6-H8: the dense cells with their mask and percentages."""
    offset = C.month_index("CohortMonth") - F.lit(params.first_month_index)
    observed = (offset + F.col("PeriodN")) <= F.lit(params.last_observed_offset)
    return cells.select(
        C.month_label("CohortMonth").alias("cohort_month"),
        F.col("PeriodN").cast("int").alias("period_n"),
        F.col("cohort_size").cast("bigint").alias("cohort_size"),
        F.col("retained").cast("bigint").alias("retained"),
        observed.alias("observed"),
        F.when(observed, C.percent_of("retained", "cohort_size")).alias("retention_pct"),
    )


#: Months per bitmask.
_BITS = 62


def month_masks(lines: DataFrame, params: AnalysisParams) -> DataFrame:
    """H1-H2 as bits: (CustomerID, first, masks), the months with a line that is not cancelled.

    ``lines`` are cleaned lines of the window or their line grain. One aggregation by
    customer with fixed-width buffers: bit k of the masks is month k of the window, ``first``
    the lowest of them, the cohort.
    """
    if "InvMonth" in lines.columns:
        month, shopped = F.col("InvMonth"), F.col("lines") > F.col("cancelled_lines")
    else:
        month, shopped = F.col("InvoiceDate"), ~F.col("IsCancellation")
    at = (C.month_index(month) - F.lit(params.first_month_index)).cast("int")
    words = range(-(-params.n_periods // _BITS))
    place = F.pmod("at", F.lit(_BITS))
    bit = [F.when(F.floor(F.col("at") / _BITS) == w, F.call_function("shiftleft", F.lit(1).cast("long"), place)) for w in words]
    return (
        lines.where(shopped & F.col("CustomerID").isNotNull())
        .select("CustomerID", at.alias("at"))
        .groupBy("CustomerID")
        .agg(F.min("at").alias("first"), *[F.bit_or(b).alias(f"m{w}") for w, b in zip(words, bit, strict=True)])
        .select("CustomerID", "first", F.array(*[F.coalesce(f"m{w}", F.lit(0).cast("long")) for w in words]).alias("masks"))
    )


def retention_by_bits(masks: DataFrame, params: AnalysisParams) -> DataFrame:
    """H3-H8 from ``month_masks``: the same rows as ``retention_long``.

    A customer is retained in period p if the bit p places above its lowest one is set; the
    counts of all periods are sums in one aggregate by cohort.
    """
    periods = range(params.n_periods)

    def active(p: int):
        at = F.col("first") + F.lit(p)
        word = F.try_element_at("masks", (F.floor(at / _BITS) + 1).cast("int"))
        return F.coalesce(F.getbit(word, F.pmod(at, F.lit(_BITS)).cast("int")).cast("long"), F.lit(0).cast("long"))

    counts = masks.groupBy("first").agg(*[F.sum(active(p)).alias(f"r{p}") for p in periods])
    start = F.trunc(C.window_start(params).cast("date"), "month")
    cells = counts.select(
        F.add_months(start, F.col("first")).cast("timestamp_ntz").alias("CohortMonth"),
        F.col("r0").alias("cohort_size"),
        F.posexplode(F.array(*[F.col(f"r{p}") for p in periods])).alias("PeriodN", "retained"),
    )
    return _observed(cells, params)


def retention_matrix(long: DataFrame, params: AnalysisParams, value: str = "retention_pct") -> DataFrame:
    """H6: cohort x period matrix, in one aggregation over the (few) cells.

    ``value="retained"`` gives the customer counts (missing cells 0, never masked);
    the default gives the percentages with unobserved cells null.
    """
    periods = list(range(params.n_periods))
    cells = [F.max(F.when(F.col("period_n") == p, F.col(value))).alias(f"m{p}") for p in periods]
    return long.groupBy("cohort_month", "cohort_size").agg(*cells).orderBy("cohort_month")


def retention_lines(long: DataFrame, params: AnalysisParams) -> DataFrame:
    """H9: retention at M+1, M+3, M+6 over observed cohorts only."""
    return long.where(F.col("period_n").isin(*params.retention_windows) & F.col("observed")).select(
        "cohort_month", F.col("period_n").alias("window"), "retention_pct"
    )


def best_worst_m1(long: DataFrame) -> DataFrame:
    """Best / worst observed M+1 retention (ties -> earliest cohort) and cohort count.

    ``max_by`` / ``min_by`` skip rows whose ordering key is null, i.e. the cells that
    are not observed M+1 cells.
    """
    obs = (F.col("period_n") == 1) & F.col("observed") & F.col("retention_pct").isNotNull()
    ordinal = C.month_index(F.to_date("cohort_month", "yyyy-MM"))
    best_key = F.when(obs, F.struct(F.col("retention_pct"), (-ordinal).alias("o")))
    worst_key = F.when(obs, F.struct(F.col("retention_pct"), ordinal.alias("o")))
    return long.agg(
        F.max_by("cohort_month", best_key).alias("best_cohort_month"),
        F.max(F.when(obs, F.col("retention_pct"))).alias("best_m1_retention_pct"),
        F.min_by("cohort_month", worst_key).alias("worst_cohort_month"),
        F.min(F.when(obs, F.col("retention_pct"))).alias("worst_m1_retention_pct"),
        F.count_distinct("cohort_month").alias("n_cohorts"),
    )
