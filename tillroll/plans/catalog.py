"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables at ``sf_dir`` through the line-item adapter,
over whole tables, with the test-table parameters.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clean as CL
from ..operators import cohorts as H
from ..operators import customer_ledger as L
from ..operators import ltv as M
from ..operators import profile as Q
from ..operators import rfm as W
from ..operators import segments as S
from ..operators.boosting import Boosting
from ..operators.customers import net_positive
from ..operators.ranking import global_rank
from ..operators.summary import SUMMARY_SCHEMA, summary_core, summary_frame, top_segments_report
from ..params import RULE_MIN_INVOICES, test_table_params
from ..session import ensure_checkpoint_dir, reliable_checkpoint
from ..sources import published, tpch_adapter
from ..sources.io import load_line_items, read_json_result, write_line_items, write_summary
from ..sources.schema import CLEAN_COLUMNS
from .analysis import RetailAnalysis

QueryFn = Callable[[SparkSession, str], DataFrame]


def _a(spark: SparkSession, sf_dir: str) -> RetailAnalysis:
    # nothing is persisted across calls
    return RetailAnalysis.from_test_tables(spark, sf_dir, test_table_params(), cache=False)


def q_line_items(spark, sf_dir):
    return _a(spark, sf_dir).raw


def q_clean_line_items(spark, sf_dir):
    a = _a(spark, sf_dir)
    return a.clean.select(*CLEAN_COLUMNS).withColumn("LineRevenue", F.col("LineRevenue").cast("double"))


def q_line_features(spark, sf_dir):
    a = _a(spark, sf_dir)
    return Q.line_features(a.clean, a.params)


def q_cleaning_log(spark, sf_dir):
    # both readers of the cleaned lines (step counts, customer counts) sit in this one
    # plan, so Spark reuses the dedup exchange (ReusedExchange) instead of a checkpoint
    return _a(spark, sf_dir).cleaning_log()


def q_non_product_audit(spark, sf_dir):
    a = _a(spark, sf_dir)
    return CL.non_product_audit(a.clean, a.params)


def _profile(fn):
    def run(spark, sf_dir):
        a = _a(spark, sf_dir)  # the raw view only
        return fn(a)

    return run


def _feature_columns(features: DataFrame) -> DataFrame:
    return features.select(
        "CustomerID",
        "Country",
        "UK_vs_International",
        "first_invoice",
        "last_invoice",
        "Tenure_days",
        "Recency",
        "Frequency",
        F.col("Monetary").cast("double").alias("Monetary"),
        "TotalQuantity",
        "TotalLines",
        "DistinctStockCodes",
        "AvgBasketSize",
        "AvgUnitPrice",
        "CancellationRate",
    )


def q_customer_features(spark, sf_dir):
    return _feature_columns(_a(spark, sf_dir).features)


def _stored_lines(spark, sf_dir) -> str:
    path = f"{ensure_checkpoint_dir(spark)}/line-items-{uuid.uuid4().hex}"
    write_line_items(tpch_adapter.line_items(spark, sf_dir), path)
    return path


def q_customer_ledger(spark, sf_dir):
    """Customer features from a ledger: lines stored by month come in month by month, every
    batch twice; half-way the months so far are merged into a base, and a month is revised."""
    params = test_table_params()
    path = _stored_lines(spark, sf_dir)
    ledger = L.CustomerLedger(spark, f"{ensure_checkpoint_dir(spark)}/customer-ledger-{uuid.uuid4().hex}")
    months = L.window_months(params)

    def lines(month):  # reads the folder of one month
        return CL.clean_line_items(load_line_items(spark, path, params=month), month)

    for k, month in enumerate(months):
        if k == len(months) // 2:
            ledger.compact()
        # the first batch of the third month lacks its returns; a revision brings the whole month
        first = lines(month).where("Quantity > 0") if k == 2 else lines(month)
        for _ in range(2):
            ledger.commit(L.month_name(month), "load", first)
    ledger.commit(L.month_name(months[2]), "revised", lines(months[2]))
    ledger.compact()
    return _feature_columns(ledger.features(params))


def q_stored_customers(spark, sf_dir):
    """The customer frame over line items stored by month, as a user of the library runs it."""
    return RetailAnalysis.from_stored(spark, _stored_lines(spark, sf_dir), test_table_params(), cache=False).customers


def q_published_customers(spark, sf_dir):
    """Active customers per segment and month, from the customer frame and the active months
    published by customer: the join reads their buckets side by side."""
    a = _a(spark, sf_dir)
    folder = f"{ensure_checkpoint_dir(spark)}/published"
    tag = uuid.uuid4().hex
    published.publish(a.customers, f"customers_{tag}", folder, a.params.customer_buckets)
    published.publish(H.active_months(a.with_customer), f"active_months_{tag}", folder, a.params.customer_buckets)
    both = spark.table(f"customers_{tag}").join(spark.table(f"active_months_{tag}"), "CustomerID")
    return both.groupBy("Segment", C.month_label("InvMonth").alias("month")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("lines")
    )


def q_cardinality_rollup(spark, sf_dir):
    """Q3 rolled up from stored month sketches, beside the exact counts: is every estimate
    within three standard errors?"""
    a = _a(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/month-sketches-{uuid.uuid4().hex}"
    Q.month_sketches(a.raw).write.parquet(path)
    rolled = Q.cardinalities_from_sketches(spark.read.parquet(path))
    both = Q.cardinalities(a.raw).select(F.struct("*").alias("exact"), F.lit(None).alias("rolled")).unionByName(
        rolled.select(F.lit(None).alias("exact"), F.struct(*rolled.columns).alias("rolled"))
    )
    one = both.agg(F.any_value("exact", F.lit(True)).alias("e"), F.any_value("rolled", F.lit(True)).alias("r"))
    error = 3 * 1.04 / 2 ** (Q.SKETCH_BITS / 2)
    near = lambda k: F.abs(F.col(f"r.{k}") - F.col(f"e.{k}")) <= F.ceil(F.lit(error) * F.col(f"e.{k}"))
    return one.select(
        F.col("r.rows").alias("rows"),
        F.col("r.span_days").alias("span_days"),
        *[F.col(f"e.{k}").alias(k) for k in Q.CARDINALITIES],
        *[near(k).alias(f"{k}_within_bound") for k in Q.CARDINALITIES],
    )


def q_customer_frame(spark, sf_dir):
    return _a(spark, sf_dir).customers


def q_frequency_rank(spark, sf_dir):
    a = _a(spark, sf_dir)
    ranked = global_rank(net_positive(a.features).select("CustomerID", "Frequency"), ["Frequency", "CustomerID"], "rank")
    return ranked.select("CustomerID", "Frequency", F.col("rank").cast("bigint").alias("rank"))


def q_rfm_triples(spark, sf_dir):
    return W.rfm_triple_counts(_a(spark, sf_dir).scored)


def q_high_value_threshold(spark, sf_dir):
    a = _a(spark, sf_dir)
    q80 = M.high_value_threshold(a.scored, a.params)
    return a.scored.agg(
        F.lit(q80).alias("threshold"),
        F.count_if(F.col("Monetary").cast("double") >= F.lit(q80)).alias("high_value_customers"),
        F.count(F.lit(1)).alias("customers"),
    )


def q_segment_summary(spark, sf_dir):
    return _a(spark, sf_dir).segment_summary


def q_headline_kpis(spark, sf_dir):
    return _a(spark, sf_dir).headline_kpis()


def q_top_segment(spark, sf_dir):
    return S.top_segment(_a(spark, sf_dir).segment_summary)


def q_top_segments(spark, sf_dir):
    a = _a(spark, sf_dir)
    return S.top_n_segments(a.segment_summary, a.params.top_segments_shown)


def q_retention_targets(spark, sf_dir):
    return _a(spark, sf_dir).retention_targets()


def q_target_pool(spark, sf_dir):
    a = _a(spark, sf_dir)
    return S.target_pool(a.scored, a.params)


def q_concentration(spark, sf_dir):
    return S.concentration(_a(spark, sf_dir).scored)


def q_guard_rails(spark, sf_dir):
    return _a(spark, sf_dir).guard_rails()


def _cohorted(a: RetailAnalysis) -> DataFrame:  # reads the cleaned lines once
    return H.with_cohort(H.active_months(a.with_customer))


def q_active_months(spark, sf_dir):
    return H.active_months(_a(spark, sf_dir).with_customer)


def q_cohort_periods(spark, sf_dir):
    return _cohorted(_a(spark, sf_dir))


def q_cohort_sizes(spark, sf_dir):
    return H.cohort_sizes(_cohorted(_a(spark, sf_dir)))


def q_retention_cells(spark, sf_dir):
    return _a(spark, sf_dir).retention_long()


def q_retention_matrix(spark, sf_dir):
    a = _a(spark, sf_dir)
    return H.retention_matrix(a.retention_long(), a.params)


def q_retained_matrix(spark, sf_dir):
    """From the cohort rows (customer, month), where the other retention reports use month bitmasks."""
    a = _a(spark, sf_dir)
    return H.retention_matrix(H.retention_long(_cohorted(a), a.params), a.params, value="retained")


def q_retention_lines(spark, sf_dir):
    a = _a(spark, sf_dir)
    return H.retention_lines(a.retention_long(), a.params)


def q_retention_best_worst(spark, sf_dir):
    return H.best_worst_m1(_a(spark, sf_dir).retention_long())


def _ltv(spark, sf_dir):
    a = _a(spark, sf_dir)
    return M.ltv_study(a.scored, a.params)


def q_ltv_model_frame(spark, sf_dir):
    a = _a(spark, sf_dir)
    return M.model_frame(a.scored, a.params)


def _folded(spark, sf_dir):
    a = _a(spark, sf_dir)
    return M.stratified_folds(M.model_frame(a.scored, a.params), a.params)


def q_ltv_folds(spark, sf_dir):
    return _folded(spark, sf_dir).select("CustomerID", M.LABEL, "fold")


def q_ltv_fold_sizes(spark, sf_dir):
    return _folded(spark, sf_dir).groupBy("fold", M.LABEL).agg(F.count(F.lit(1)).alias("customers"))


def q_ltv_holdout_sizes(spark, sf_dir):
    a = _a(spark, sf_dir)
    frame = M.model_frame(a.scored, a.params)
    parts = [p.withColumn("held", F.lit(k == 1)) for k, p in enumerate(M.holdout_split(frame, a.params))]
    return parts[0].unionByName(parts[1]).groupBy("held", M.LABEL).agg(F.count(F.lit(1)).alias("customers"))


def q_ltv_gradient_sums(spark, sf_dir):
    """The first round of the learner over all customers: sums per (feature, bin)."""
    a = _a(spark, sf_dir)
    frame = M.model_frame(a.scored, a.params).withColumn("member", F.lit(1))
    params = a.params.with_(gbt_early_stopping_rows=(1 << 62))  # no customer is set aside
    return Boosting(reliable_checkpoint(frame), M.LABEL, "CustomerID", params, 1).first_histogram()


def q_top_features_on_rule(spark, sf_dir):
    """M10 over an importance that needs no model: how well a feature alone ranks the label."""
    a = _a(spark, sf_dir)
    frame = M.model_frame(a.scored, a.params)
    named = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("score")) for c in a.params.ltv_features])
    scores = frame.select("CustomerID", M.LABEL, F.inline(named))
    auc = M.auc_by_group(scores, ["feature"], "score", M.LABEL, "CustomerID")
    importance = auc.select("feature", F.abs(F.col("auc") - 0.5).alias("importance"))
    top3, non_rfm = M.top_features(importance, a.params)
    rows = [("top 3", k + 1, t["name"], t["importance"]) for k, t in enumerate(top3)]
    rows += [("top 2 outside recency and frequency", k + 1, name, None) for k, name in enumerate(non_rfm)]
    return spark.createDataFrame(rows, "list string, place int, feature string, importance double")


def _rule_predictions(spark, sf_dir):
    """A prediction that needs no model: many invoices. Folds by id, so that SQL can follow."""
    a = _a(spark, sf_dir)
    frame = M.model_frame(a.scored, a.params)
    return frame.select(
        "CustomerID",
        M.LABEL,
        (F.col("CustomerID") % a.params.n_folds).cast("int").alias("fold"),
        F.col("Frequency").alias("prob"),
        (F.col("Frequency") >= RULE_MIN_INVOICES).cast("int").alias("prediction"),
    )


def q_metrics_on_rule(spark, sf_dir):
    return M.classification_metrics(_rule_predictions(spark, sf_dir))


def q_confusion_on_rule(spark, sf_dir):
    return M.confusion_matrix(_rule_predictions(spark, sf_dir))


def q_auc_on_rule(spark, sf_dir):
    return M.auc_by_group(_rule_predictions(spark, sf_dir), ["fold"], "prob", M.LABEL, "CustomerID")


def q_ltv_oof_predictions(spark, sf_dir):
    return _ltv(spark, sf_dir).oof


def q_ltv_cv_metrics(spark, sf_dir):
    r = _ltv(spark, sf_dir)
    parts = [r.auc, r.metrics, r.confusion]
    out = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def q_ltv_permutation_importance(spark, sf_dir):
    return _ltv(spark, sf_dir).importance


def q_ltv_partial_dependence(spark, sf_dir):
    parts = list(_ltv(spark, sf_dir).pd.values())
    return reduce(DataFrame.unionByName, parts)


def q_summary_core(spark, sf_dir):
    """The summary document without its model block."""
    return summary_core(_a(spark, sf_dir))


def q_summary(spark, sf_dir):
    a = _a(spark, sf_dir)
    a.grain  # stored first: the scored customers and the cleaning log are folded from it as well
    return summary_frame(a, M.ltv_study(a.scored, a.params))


def q_stored_summary(spark, sf_dir):
    """The report's side: the summary document is written as JSON, read back and its top segments listed."""
    a = _a(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/summary-{uuid.uuid4().hex}"
    write_summary(summary_frame(a), path)
    return top_segments_report(read_json_result(spark, path, schema=SUMMARY_SCHEMA), a.params.top_segments_shown)


def q_stored_line_items(spark, sf_dir):
    """The path a user calls: line items stored by month, loaded for the window, cleaned and summed by month."""
    params = test_table_params()
    stored = load_line_items(spark, _stored_lines(spark, sf_dir), params=params)
    clean = CL.clean_line_items(stored, params)
    return (
        clean.groupBy(C.month_start("InvoiceDate").alias("m"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("LineRevenue").cast("double").alias("revenue"))
        .select(C.month_label("m").alias("month"), "rows", "revenue")
    )


QUERIES: dict[str, QueryFn] = {
    # sources and cleaning
    "line_items": q_line_items,
    "stored_line_items": q_stored_line_items,
    "clean_line_items": q_clean_line_items,
    "line_features": q_line_features,
    "cleaning_log": q_cleaning_log,
    "non_product_audit": q_non_product_audit,
    # profile and quality (raw view)
    "rows_per_month": _profile(lambda a: Q.rows_per_month(a.raw)),
    "top_countries_by_rows": _profile(lambda a: Q.top_countries_by_rows(a.raw, a.params.top_countries_by_rows)),
    "cardinalities": _profile(lambda a: Q.cardinalities(a.raw)),
    "cardinality_rollup": q_cardinality_rollup,
    "quality_flags": _profile(lambda a: Q.quality_flags(a.raw, a.params)),
    "null_profile": _profile(lambda a: Q.null_profile(a.raw)),
    "date_range": _profile(lambda a: Q.date_range(a.raw)),
    "monthly_net_revenue": _profile(lambda a: Q.monthly_net_revenue(a.raw)),
    "country_revenue": _profile(lambda a: Q.country_revenue(a.raw, a.params.top_countries_by_revenue)),
    "invoice_sizes": _profile(lambda a: Q.invoice_sizes(a.raw)),
    "quantity_histogram": _profile(lambda a: Q.quantity_histogram(a.raw, a.params.histogram_bins)),
    "unit_price_histogram": _profile(lambda a: Q.unit_price_histogram(a.raw, a.params.histogram_bins)),
    "invoice_lines_histogram": _profile(lambda a: Q.invoice_lines_histogram(a.raw, a.params.histogram_bins)),
    "invoice_total_histogram": _profile(
        lambda a: Q.invoice_total_histogram(a.raw, a.params.histogram_bins, a.params.invoice_total_clip)
    ),
    "purchases_vs_returns": _profile(lambda a: Q.purchases_vs_returns(a.raw, a.params)),
    # customers and RFM
    "customer_features": q_customer_features,
    "customer_ledger": q_customer_ledger,
    "stored_customers": q_stored_customers,
    "published_customers": q_published_customers,
    "customer_frame": q_customer_frame,
    "frequency_rank": q_frequency_rank,
    "rfm_triples": q_rfm_triples,
    "high_value_threshold": q_high_value_threshold,
    # KPIs and segments
    "segment_summary": q_segment_summary,
    "headline_kpis": q_headline_kpis,
    "top_segment": q_top_segment,
    "top_segments": q_top_segments,
    "retention_targets": q_retention_targets,
    "target_pool": q_target_pool,
    "concentration": q_concentration,
    "guard_rails": q_guard_rails,
    # cohorts
    "active_months": q_active_months,
    "cohort_periods": q_cohort_periods,
    "cohort_sizes": q_cohort_sizes,
    "retention_cells": q_retention_cells,
    "retention_matrix": q_retention_matrix,
    "retained_matrix": q_retained_matrix,
    "retention_lines": q_retention_lines,
    "retention_best_worst": q_retention_best_worst,
    # high-value-customer model (rows-only checks except the model frame)
    "ltv_model_frame": q_ltv_model_frame,
    "ltv_folds": q_ltv_folds,
    "ltv_fold_sizes": q_ltv_fold_sizes,
    "ltv_holdout_sizes": q_ltv_holdout_sizes,
    "ltv_gradient_sums": q_ltv_gradient_sums,
    "top_features_on_rule": q_top_features_on_rule,
    "metrics_on_rule": q_metrics_on_rule,
    "confusion_on_rule": q_confusion_on_rule,
    "auc_on_rule": q_auc_on_rule,
    "ltv_oof_predictions": q_ltv_oof_predictions,
    "ltv_cv_metrics": q_ltv_cv_metrics,
    "ltv_permutation_importance": q_ltv_permutation_importance,
    "ltv_partial_dependence": q_ltv_partial_dependence,
    # summary document
    "summary_core": q_summary_core,
    "stored_summary": q_stored_summary,
    "summary": q_summary,
}
