"""V1: the nested summary document, built in the plan with fixed types.

Every piece is a small aggregate (7 log rows, at most 11 segments, months^2 cohort cells,
one KPI row). Pieces become one row each, are stacked by a union and merged by
``any_value``. Steps and segments are map keys, so the schema does not depend on the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cohorts as H
from . import segments as S

_TEXT, _NUMBER, _COUNT = T.StringType(), T.DoubleType(), T.LongType()


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in kinds.items()])


SUMMARY_SCHEMA = _fields(
    dataset=_fields(
        raw_rows=_COUNT,
        cleaned_rows=_COUNT,
        customers=_COUNT,
        analysis_window_start=_TEXT,
        analysis_window_end=_TEXT,
        currency=_TEXT,
    ),
    cleaning=T.MapType(_TEXT, _fields(rows_before=_COUNT, rows_after=_COUNT, note=_TEXT)),
    kpis=_fields(
        total_revenue_gbp=_NUMBER,
        total_revenue_customer_attributed_gbp=_NUMBER,
        aov_gbp=_NUMBER,
        total_customers=_COUNT,
        total_invoices_customer_attributed=_COUNT,
        repeat_purchase_rate=_NUMBER,
        repeat_customer_count=_COUNT,
    ),
    segments=T.MapType(_TEXT, _fields(revenue_gbp=_NUMBER, revenue_share_pct=_NUMBER, customers=_COUNT)),
    top_segment=_fields(name=_TEXT, revenue_gbp=_NUMBER, revenue_share_pct=_NUMBER, customer_count=_COUNT),
    cohort=_fields(
        best_cohort_month=_TEXT,
        best_m1_retention_pct=_NUMBER,
        worst_cohort_month=_TEXT,
        worst_m1_retention_pct=_NUMBER,
        n_cohorts=_COUNT,
    ),
    retention_targets=T.ArrayType(
        _fields(segment=_TEXT, customers=_COUNT, revenue_gbp=_NUMBER, revenue_share_pct=_NUMBER)
    ),
    ltv=_fields(
        model=_TEXT,
        target=_TEXT,
        target_threshold_gbp=_NUMBER,
        cv=_TEXT,
        roc_auc_mean=_NUMBER,
        roc_auc_std=_NUMBER,
        precision=_NUMBER,
        recall=_NUMBER,
        f1=_NUMBER,
        confusion_matrix=T.ArrayType(T.ArrayType(_COUNT)),
        top_3_features=T.ArrayType(_fields(name=_TEXT, importance=_NUMBER)),
        top_2_non_rfm_features=T.ArrayType(_TEXT),
    ),
)


def _rounded(c: str, places: int = 2) -> Column:
    return F.round(F.col(c).cast("double"), places)


def _typed(c: Column, name: str) -> Column:
    return c.cast(SUMMARY_SCHEMA[name].dataType).alias(name)


def _map_of(key: str, *fields: Column) -> Column:
    return F.map_from_entries(F.collect_list(F.struct(F.col(key), F.struct(*fields))))


def summary_frame(analysis, ltv=None) -> DataFrame:
    """One row with the types of ``SUMMARY_SCHEMA``; ``ltv`` is null without a model."""
    p = analysis.params
    kpis = analysis.headline_kpis()  # stores the line grain that everything else is folded from
    segments = analysis.segment_summary
    revenue, share = _rounded("Revenue").alias("revenue_gbp"), _rounded("Revenue_share").alias("revenue_share_pct")
    customers = F.col("Customers").cast("bigint")
    log = analysis.cleaning_log().agg(_typed(_map_of("step", F.col("rows_before"), F.col("rows_after"), F.col("note")), "cleaning"))
    headline = kpis.select(
        _typed(
            F.struct(
                _rounded("total_revenue_gbp"),
                _rounded("total_revenue_customer_attributed_gbp"),
                _rounded("aov_gbp"),
                F.col("total_customers"),
                F.col("total_invoices_customer_attributed"),
                _rounded("repeat_purchase_rate", 4),
                F.col("repeat_customer_count"),
            ),
            "kpis",
        )
    )
    by_segment = segments.agg(_typed(_map_of("Segment", revenue, share, customers), "segments"))
    top = S.top_segment(segments).select(_typed(F.struct("Segment", revenue, share, customers), "top_segment"))
    cohort = H.best_worst_m1(analysis.retention_long()).select(
        _typed(
            F.struct(
                "best_cohort_month",
                _rounded("best_m1_retention_pct"),
                "worst_cohort_month",
                _rounded("worst_m1_retention_pct"),
                "n_cohorts",
            ),
            "cohort",
        )
    )
    place = F.array_position(F.array(*map(F.lit, p.target_segments)), F.col("Segment"))
    listed = F.array_sort(F.collect_list(F.struct(place.alias("at"), "Segment", customers.alias("n"), revenue, share)))
    targets = analysis.retention_targets().agg(
        _typed(F.transform(listed, lambda x: F.struct(x["Segment"], x["n"], x["revenue_gbp"], x["revenue_share_pct"])), "retention_targets")
    )
    parts = [log, headline, by_segment, top, cohort, targets]
    one = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    one = one.agg(*[F.any_value(c, F.lit(True)).alias(c) for part in parts for c in part.columns])
    step = lambda k, f: F.col("cleaning")[k][f]
    dataset = F.struct(
        step("01_trim_period", "rows_before"),
        step("03_drop_exact_duplicates", "rows_after"),
        F.col("kpis.total_customers"),
        F.lit(str(p.start_ts.date())),
        F.lit(str(p.end_ts.date())),
        F.lit(p.currency),
    )
    model = F.lit(None) if ltv is None else _ltv_struct(ltv.summary())
    return one.withColumns({"dataset": _typed(dataset, "dataset"), "ltv": _typed(model, "ltv")}).select(
        *SUMMARY_SCHEMA.fieldNames()
    )


def _ltv_struct(found: dict) -> Column:
    """The model block from its few scalars (the model's metrics are read on the driver)."""
    nested = {
        "confusion_matrix": F.array(*[F.array(*map(F.lit, row)) for row in found["confusion_matrix"]]),
        "top_3_features": F.array(
            *[F.struct(F.lit(t["name"]).alias("name"), F.lit(t["importance"]).alias("importance")) for t in found["top_3_features"]]
        ),
        "top_2_non_rfm_features": F.array(*map(F.lit, found["top_2_non_rfm_features"])),
    }
    fields = SUMMARY_SCHEMA["ltv"].dataType.fieldNames()
    return F.struct(*[(nested[k] if k in nested else F.lit(found[k])).alias(k) for k in fields])


def summary_core(analysis) -> DataFrame:
    """The document without its model block as rows (section, name, field, number, text)."""
    doc = summary_frame(analysis)
    rows = []

    def add(section: str, name: Column, holder: Column, kind: T.StructType) -> None:
        for f in kind.fields:
            value = holder[f.name]
            text = isinstance(f.dataType, T.StringType)
            rows.append(
                F.struct(
                    F.lit(section).alias("section"),
                    name.alias("name"),
                    F.lit(f.name).alias("field"),
                    (F.lit(None) if text else value).cast("double").alias("number"),
                    (value if text else F.lit(None)).cast("string").alias("text"),
                )
            )

    flat = []
    for k in ("dataset", "kpis", "top_segment", "cohort"):
        add(k, F.lit(""), F.col(k), SUMMARY_SCHEMA[k].dataType)
    flat.append(doc.select(F.inline(F.array(*rows))))
    for k in ("cleaning", "segments"):
        rows = []
        kind = SUMMARY_SCHEMA[k].dataType.valueType
        entries = doc.select(F.explode(k).alias("key", "value"))
        add(k, F.col("key"), F.col("value"), kind)
        flat.append(entries.select(F.inline(F.array(*rows))))
    rows = []
    targets = doc.select(F.explode("retention_targets").alias("t"))
    kind = T.StructType([f for f in SUMMARY_SCHEMA["retention_targets"].dataType.elementType.fields if f.name != "segment"])
    add("retention_targets", F.col("t.segment"), F.col("t"), kind)
    flat.append(targets.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, flat)


def top_segments_report(summary: DataFrame, n: int = 6) -> DataFrame:
    """K5 over a summary read back (IO7): segments by revenue with bar width."""
    rows = summary.select(F.explode("segments").alias("Segment", "v")).select(
        "Segment",
        F.col("v.revenue_gbp").alias("Revenue"),
        F.col("v.customers").alias("Customers"),
        F.col("v.revenue_share_pct").alias("Revenue_share"),
    )
    return S.top_n_segments(rows, n)


def guard_rails_from_summary(summary: DataFrame, params) -> DataFrame:
    """V2 over a summary read back from JSON (IO7), as the report runs it."""
    from .kpis import kpi_guard_rails

    kpis = summary.select(
        F.col("kpis.total_revenue_gbp").cast("double").alias("total_revenue_gbp"),
        F.col("kpis.total_customers").alias("total_customers"),
        F.col("kpis.repeat_purchase_rate").cast("double").alias("repeat_purchase_rate"),
    )
    top = summary.select(F.col("top_segment.revenue_share_pct").cast("double").alias("Revenue_share"))
    return kpi_guard_rails(kpis, top, params)
