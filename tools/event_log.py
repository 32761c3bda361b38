"""Job and stage times of registered queries from Spark's event log (no UI, no server).

Runs the named queries at ``sf_dir`` in a local session that writes its event log to
a fresh scratch folder, then prints one line per job of each query: start offset,
duration, and (stage id, ms, tasks) of the stages that ran.

usage: python tools/event_log.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import glob
import io
import json
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def _lines(log_dir: str):
    for f in sorted(glob.glob(f"{log_dir}/*/events*") + glob.glob(f"{log_dir}/*.zstd") + glob.glob(f"{log_dir}/app*")):
        raw = Path(f).read_bytes()
        if f.endswith(".zstd"):
            import zstandard

            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        yield from raw.decode().splitlines()


def job_table(log_dir: str, groups: set[str]) -> list[tuple]:
    """(group, job id, start ms, duration ms, [(stage, ms, tasks)]) per job of ``groups``."""
    jobs: dict[int, list] = {}
    stages: dict[int, tuple[int, int]] = {}
    for line in _lines(log_dir):
        e = json.loads(line)
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            g = e.get("Properties", {}).get("spark.jobGroup.id")
            jobs[e["Job ID"]] = [g, e["Submission Time"], None, [s["Stage ID"] for s in e["Stage Infos"]]]
        elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]][2] = e["Completion Time"]
        elif ev == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            if si.get("Submission Time") and si.get("Completion Time"):
                stages[si["Stage ID"]] = (si["Completion Time"] - si["Submission Time"], si["Number of Tasks"])
    out = []
    for j, (g, start, end, ids) in sorted(jobs.items()):
        if g in groups and end is not None:
            out.append((g, j, start, end - start, [(s, *stages[s]) for s in ids if s in stages]))
    return out


def main(argv):
    from pyspark.sql import SparkSession

    from tillroll.plans.catalog import QUERIES
    from tillroll.session import configure

    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")] or ["segment_summary"]
    log_dir = tempfile.mkdtemp(prefix="tillroll-eventlog-")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "16")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", log_dir)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    for name in names:
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        print(f"{name}: {time.perf_counter() - t0:.2f} s", flush=True)
    spark.stop()
    table = job_table(log_dir, set(names))
    first: dict[str, int] = {}
    for g, _, start, _, _ in table:
        first[g] = min(first.get(g, start), start)
    for g, j, start, dur, st in table:
        print(f"{g} job {j} t+{start - first[g]} ms, {dur} ms, stages {st}")
    print(f"event log: {log_dir}")


if __name__ == "__main__":
    main(sys.argv[1:])
