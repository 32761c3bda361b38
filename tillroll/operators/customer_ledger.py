"""C1-C10 kept up month by month: a ledger of mergeable customer state.

A month's state are its ``customer_facets``: per customer the measures of each invoice, stock
code and country. States of different months merge by one aggregation over the same keys,
because sums, minima, maxima and sets of values do; exact duplicates have the same date, so
cleaning a month by itself removes them all. A new month reads and writes its own rows only.

Commits are idempotent: a batch that a month has already is not applied again. Another batch
of the same month takes the place of the one before (a revision). A version counts once
Spark's commit marker is there, so a write that broke off is never read, and its number is
not used again. ``compact`` merges the months so far into one base; a base that no longer
agrees with its months, after a revision, is not used.

    <path>/month=1997-03/v=000001-<batch>/   state of a month
    <path>/base/v=000001/state, /months      merged state and the versions that it covers
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..params import AnalysisParams
from ..session import is_complete, list_folders
from .customers import customer_facets, features_from_facets, measured, merge_facets

_BATCH = re.compile(r"[A-Za-z0-9_.-]+")


class CustomerLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------------------ versions
    def _versions(self, month: str) -> list[str]:
        return list_folders(self.spark, f"{self.path}/month={month}")

    def _complete(self, month: str) -> list[str]:
        return [v for v in self._versions(month) if is_complete(self.spark, f"{self.path}/month={month}/{v}")]

    def months(self) -> dict[str, str]:
        """month -> the version that counts; looks at folder names only."""
        found = [d.removeprefix("month=") for d in list_folders(self.spark, self.path) if d.startswith("month=")]
        return {m: versions[-1] for m in found if (versions := self._complete(m))}

    def commit(self, month: str, batch: str, clean_lines: DataFrame) -> bool:
        """Store the state of a month (``yyyy-MM``) from its cleaned lines; False if the month has the batch.

        Only the folder of this month is looked at.
        """
        if not _BATCH.fullmatch(batch):
            raise ValueError(f"a batch is named by letters, digits, '_', '.' and '-', not {batch!r}")
        if any(v.partition("-")[2] == batch for v in self._complete(month)):
            return False
        used = [int(v[2:8]) for v in self._versions(month)]
        folder = f"{self.path}/month={month}/v={max(used, default=0) + 1:06d}-{batch}"
        customer_facets(measured(clean_lines)).write.parquet(folder)
        return True

    # -------------------------------------------------------------------------- reading
    def _base(self, months: dict[str, str]) -> tuple[str, dict[str, str]] | None:
        """The newest base whose months all have the versions that it was made from."""
        for v in reversed(list_folders(self.spark, f"{self.path}/base")):
            folder = f"{self.path}/base/{v}"
            if all(is_complete(self.spark, f"{folder}/{part}") for part in ("state", "months")):
                covered = {r["m"]: r["version"] for r in self.spark.read.parquet(f"{folder}/months").collect()}
                if covered.items() <= months.items():
                    return f"{folder}/state", covered
        return None

    def state(self) -> DataFrame | None:
        """The merged state of all months; None before the first commit. A base or a month alone
        is merged already."""
        months = self.months()
        base = self._base(months)
        covered = base[1] if base else {}
        paths = [base[0]] if base else []
        paths += [f"{self.path}/month={m}/{v}" for m, v in sorted(months.items()) if m not in covered]
        if not paths:
            return None
        parts = [self.spark.read.parquet(p) for p in paths]
        return parts[0] if len(parts) == 1 else merge_facets(reduce(DataFrame.unionByName, parts))

    def features(self, params: AnalysisParams) -> DataFrame | None:
        """C1-C10 of all customers over all months."""
        state = self.state()
        return None if state is None else features_from_facets(state, params)

    def compact(self) -> str | None:
        """Merge all months into a new base; None if the newest base covers them all."""
        months = self.months()
        base = self._base(months)
        if not months or (base and base[1] == months):
            return None
        used = [int(v[2:8]) for v in list_folders(self.spark, f"{self.path}/base")]
        folder = f"{self.path}/base/v={max(used, default=0) + 1:06d}"
        self.state().write.parquet(f"{folder}/state")
        rows = self.spark.createDataFrame(sorted(months.items()), "m string, version string")
        rows.coalesce(1).write.parquet(f"{folder}/months")  # written last: a base without it is not read
        return folder


def window_months(params: AnalysisParams) -> list[AnalysisParams]:
    """The analysis window cut at the months: one set of parameters per month."""
    out, start = [], params.start_ts
    while start <= params.end_ts:
        following = datetime(start.year + start.month // 12, start.month % 12 + 1, 1)
        end = min(params.end_ts, following - timedelta(seconds=1))
        out.append(params.with_(window_start=str(start), window_end=str(end)))
        start = following
    return out


def month_name(params: AnalysisParams) -> str:
    return params.start_ts.strftime("%Y-%m")
