"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The flagship's first run in the new session is printed as ``cold_first_pass`` beside the
queries; it also warms up class loading, JIT and the codegen cache for the rest. Each
query's plan is executed in full with the ``noop`` sink (no driver collect).
The model's parts (cross-validated metrics, permutation importance, partial dependence,
summary document) are timed in one study, in this order; all models (five folds and the
hold-out) are fitted together and count under the metrics.
``end_to_end`` computes every output of the study in one session, the way a user
runs it: the cleaned line items and the scored customers are cached once and shared.
"""

from __future__ import annotations

import json
import os
import sys
import time
from functools import reduce
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "segment_summary",
    "customer_frame",
    "headline_kpis",
    "cleaning_log",
    "retention_cells",
    "clean_line_items",
    "quality_flags",
    "monthly_net_revenue",
    "invoice_sizes",
    "country_revenue",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tillroll.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    from tillroll.operators.ltv import ltv_study
    from tillroll.operators.summary import summary_frame
    from tillroll.plans.analysis import RetailAnalysis
    from tillroll.plans.catalog import QUERIES

    t0 = time.perf_counter()
    _run(QUERIES["segment_summary"](spark, sf_dir))
    cold = round(time.perf_counter() - t0, 3)

    timings: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        _run(QUERIES[name](spark, sf_dir))
        timings[name] = round(time.perf_counter() - t0, 3)

    a = RetailAnalysis.from_test_tables(spark, sf_dir, cache=False)
    t0 = time.perf_counter()
    study = ltv_study(a.scored, a.params)
    for f in (study.auc, study.metrics, study.confusion):
        _run(f)
    timings["ltv_cv_metrics"] = round(time.perf_counter() - t0, 3)
    for name, part in (
        ("ltv_permutation_importance", lambda: study.importance),
        ("ltv_partial_dependence", lambda: reduce(type(a.raw).unionByName, study.pd.values())),
        ("summary", lambda: summary_frame(a, study)),
    ):
        t0 = time.perf_counter()
        _run(part())
        timings[name] = round(time.perf_counter() - t0, 3)

    t0 = time.perf_counter()
    a = RetailAnalysis.from_test_tables(spark, sf_dir)
    outputs = {
        **a.profile().tables(),
        "clean": a.clean,
        "customers": a.customers,
        "segment_summary": a.segment_summary,
        "kpis": a.headline_kpis(),
        "cleaning_log": a.cleaning_log(),
        "retention": a.retention_long(),
        "targets": a.retention_targets(),
        "guard_rails": a.guard_rails(),
    }
    for df in outputs.values():
        _run(df)
    a.close()
    timings["end_to_end"] = round(time.perf_counter() - t0, 3)

    sf = Path(sf_dir).name.replace("sf", "")
    total = round(sum(timings.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total_sec",
                "value": total,
                "unit": "sec",
                "queries": timings,
                "cold_first_pass": cold,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": int(cpus) if str(cpus).isdigit() else cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
