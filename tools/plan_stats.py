"""Shape of each registered query's physical plan: shuffles, broadcasts, single-partition
exchanges and whole-stage-codegen coverage.

usage: python tools/plan_stats.py [sf_dir] [name ...]
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plan_text(df) -> str:
    """The executed plan; for a finished adaptive plan only its final section."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def stats(df) -> dict:
    # run this DataFrame's own query execution (a write would plan a separate one), so
    # the adaptive plan is final and shows its whole-stage-codegen stages as *(n)
    df._jdf.queryExecution().toRdd().count()
    text = plan_text(df)
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin)", text)),
        "single_partition": len(re.findall(r"Exchange SinglePartition", text)),
        "broadcasts": len(re.findall(r"BroadcastExchange", text)),
        "python": len(re.findall(r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas)", text)),
        "sort_merge_joins": len(re.findall(r"SortMergeJoin", text)),
        # distinct whole-stage-codegen stage ids (*(n) prefixes in the final plan)
        "codegen_stages": len(set(re.findall(r"\*\((\d+)\)", text))),
    }


def main(argv):
    from tillroll.plans.catalog import QUERIES
    from tillroll.session import local_session

    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")] or [n for n in QUERIES if not n.startswith("ltv_") and n != "summary"]
    spark = local_session(8, 16)
    for name in names:
        print(name, stats(QUERIES[name](spark, sf_dir)), flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
