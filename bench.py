"""Time every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (all rows
produced, none collected). A warm-up pass on the smallest data set loads
classes and compiles code first (``BENCH_WARMUP=0`` skips it), so the
timings are of the queries, not of JVM start-up. Spark's event log, written to a fresh scratch folder, adds
each query's executed stages, input records and shuffle records/bytes
written (first timed run). Stages include the small job Spark runs to read
a Parquet footer for the schema, so a map-only query shows 2. Input bytes are not reported: the Parquet reader does part of its I/O
outside the task thread, where Spark's per-thread byte counters miss it.
Prints one JSON line; a query that fails gets a null time and its error
under "failed", and the total covers the queries that ran.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tablewright.plans.registry import QUERIES  # noqa: E402

WARMUP_SF_DIR = "/root/testdata/sf0.001"


def session(cpus: int, log_dir: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablewright-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(2 * cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.eventLog.enabled", "true")
        .config("spark.eventLog.dir", log_dir)
        .config("spark.eventLog.compress", "false")
        .config("spark.eventLog.rolling.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run_once(spark: SparkSession, fn, sf_dir: str, label: str) -> float:
    spark.sparkContext.setJobDescription(label)
    try:
        start = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start
    finally:
        spark.sparkContext.setJobDescription(None)


def io_per_label(log_dir: str) -> dict[str, dict[str, int]]:
    """Stages run, input records and shuffle records/bytes written, over each label's jobs."""
    stage_label: dict[int, str] = {}
    totals: dict[str, dict[str, int]] = {}
    stages_seen: dict[str, set[int]] = {}
    for path in glob.glob(f"{log_dir}/*"):
        with open(path) as fh:
            for line in fh:
                try:
                    event = json.loads(line)
                except json.JSONDecodeError:
                    continue
                kind = event.get("Event")
                if kind == "SparkListenerJobStart":
                    label = (event.get("Properties") or {}).get("spark.job.description")
                    if label:
                        for stage in event["Stage IDs"]:
                            stage_label[stage] = label
                elif kind == "SparkListenerTaskEnd" and event.get("Stage ID") in stage_label:
                    metrics = event.get("Task Metrics") or {}
                    label = stage_label[event["Stage ID"]]
                    slot = totals.setdefault(label, {"input_records": 0, "shuffle_records": 0, "shuffle_bytes": 0})
                    stages_seen.setdefault(label, set()).add(event["Stage ID"])
                    shuffle = metrics.get("Shuffle Write Metrics") or {}
                    slot["input_records"] += (metrics.get("Input Metrics") or {}).get("Records Read", 0)
                    slot["shuffle_records"] += shuffle.get("Shuffle Records Written", 0)
                    slot["shuffle_bytes"] += shuffle.get("Shuffle Bytes Written", 0)
    for label, stages in stages_seen.items():
        totals[label]["stages"] = len(stages)
    return totals


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = max(int(os.environ.get("BENCH_REPEATS", "3")), 1)
    log_dir = tempfile.mkdtemp(prefix="tw-bench-events-")
    spark = session(cpus, log_dir)
    if os.environ.get("BENCH_WARMUP", "1") != "0" and os.path.isdir(WARMUP_SF_DIR):
        for name, fn in QUERIES.items():
            try:
                run_once(spark, fn, WARMUP_SF_DIR, f"warmup:{name}")
            except Exception:  # the timed run reports it
                pass
    times: dict[str, float | None] = {}
    failed: dict[str, str] = {}
    for name, fn in QUERIES.items():
        try:
            runs = [run_once(spark, fn, sf_dir, f"bench:{name}:{i}") for i in range(repeats)]
            times[name] = round(min(runs), 4)
        except Exception as exc:  # record it and go on: one failure must not hide the rest
            times[name] = None
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    spark.stop()  # flushes the event log
    io = io_per_label(log_dir)
    sf = os.path.basename(sf_dir)
    sf = sf[2:] if sf.startswith("sf") else sf
    try:
        sf_value: float | str = float(sf)
    except ValueError:
        sf_value = sf
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(t for t in times.values() if t is not None), 4),
                "unit": "sec",
                "queries": times,
                "sf": sf_value,
                "cpus": cpus,
                "repeats": repeats,
                "failed": failed,
                **{
                    metric: {n: io.get(f"bench:{n}:0", {}).get(metric, 0) for n in QUERIES}
                    for metric in ("stages", "input_records", "shuffle_records", "shuffle_bytes")
                },
            }
        )
    )


if __name__ == "__main__":
    main()
