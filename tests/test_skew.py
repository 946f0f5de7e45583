"""A key holding a third of all rows must not become one task's work.

Inputs are derived from the driver's tables with every third row moved to
one hot key. Task metrics come from Spark's event log: the largest number
of shuffle records any task of the final aggregation reads. With map-side
combining that is about one row per key per map task; a per-key window
that keeps every row reads all hot rows in one task (the control)."""

import glob
import json
import time
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_ORACLE
from tablewright.operators import deduplicate, latest_per_key, manifest
from tablewright.sources import load_table

MAP_TASKS = 8


def final_stage_max_records(spark, run) -> int:
    """Run ``run()`` under a unique job description; return the max shuffle
    records read by one task of the last stage that read a shuffle."""
    label = f"skew-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    sc.setJobDescription(label)
    # Keep one reduce task per hash partition: AQE would otherwise merge
    # these small partitions into one task and hide where the hot key went.
    coalesce_conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce_conf)
    spark.conf.set(coalesce_conf, "false")
    try:
        run()
    finally:
        sc.setJobDescription(None)
        spark.conf.set(coalesce_conf, before)
    log_dir = spark.conf.get("spark.eventLog.dir").replace("file:", "")
    # The listener bus is asynchronous: wait until every job of the label has
    # its JobEnd in the log (written, with a flush, after its tasks' events).
    deadline = time.time() + 30
    while True:
        events = read_events(log_dir)
        jobs = {
            e["Job ID"]: e["Stage IDs"]
            for e in events
            if e["Event"] == "SparkListenerJobStart" and e.get("Properties", {}).get("spark.job.description") == label
        }
        ended = {e["Job ID"] for e in events if e["Event"] == "SparkListenerJobEnd"}
        if jobs and set(jobs) <= ended:
            break
        assert time.time() < deadline, "event log did not catch up"
        time.sleep(0.2)
    stages = {stage for ids in jobs.values() for stage in ids}
    reads = {}
    for e in events:
        if e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in stages:
            n = e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"]
            reads.setdefault(e["Stage ID"], []).append(n)
    reading = [s for s, r in reads.items() if sum(r) > 0]
    assert reading, "no shuffle stage found in the event log"
    return max(reads[max(reading)])


def read_events(log_dir):
    events = []
    for path in glob.glob(f"{log_dir}/*"):
        with open(path) as fh:
            for line in fh:
                if line.strip():
                    try:
                        events.append(json.loads(line))
                    except json.JSONDecodeError:
                        pass  # a line still being written
    return events


def noop(df):
    return lambda: df.write.format("noop").mode("overwrite").save()


def hot_events(spark):
    ev = load_table(spark, SF_ORACLE, "events")
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id"))
    return ev.withColumn("user_id", hot).repartition(MAP_TASKS), ev.count() // 3


def hot_documents(spark):
    docs = load_table(spark, SF_ORACLE, "documents")
    hot = F.when(F.col("doc_id") % 3 == 0, F.lit("the same text " * 200)).otherwise(F.col("text"))
    return docs.withColumn("text", hot).repartition(MAP_TASKS), docs.count() // 3


def test_latest_per_key_combines_hot_key(spark):
    df, hot_rows = hot_events(spark)
    worst = final_stage_max_records(spark, noop(latest_per_key(df, ["user_id"], ["ts", "event_id"])))
    assert worst < hot_rows / 2, (worst, hot_rows)


def test_dedup_combines_hot_text(spark):
    df, hot_rows = hot_documents(spark)
    worst = final_stage_max_records(spark, noop(deduplicate(df, ["text"], ["doc_id"])))
    assert worst < hot_rows / 2, (worst, hot_rows)


def test_manifest_combines_hot_group(spark):
    df, hot_rows = hot_documents(spark)
    one_group = df.withColumn("source", F.lit("all"))
    worst = final_stage_max_records(spark, noop(manifest(one_group, ["source"], "text")))
    assert worst <= MAP_TASKS


def test_control_window_puts_hot_key_in_one_task(spark):
    """The measurement does see a hot key: a per-key window that keeps every
    row reads all hot rows in one task. (Spark 4 rewrites ``row_number() = 1``
    into a partial ``WindowGroupLimit``, so that shape is combined map-side too.)"""
    df, hot_rows = hot_events(spark)
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    windowed = df.withColumn("rn", F.row_number().over(w))
    worst = final_stage_max_records(spark, noop(windowed))
    assert worst >= hot_rows
