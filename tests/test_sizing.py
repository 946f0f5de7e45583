"""Files sized by bytes: the bound holds for hot keys too, and the stage before stays wide."""

import glob
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SF_ORACLE
from test_skew import read_events
from tablewright.config import ConfigError
from tablewright.operators import rebalance, sized
from tablewright.plans import run
from tablewright.session import fresh_path
from tablewright.sinks import write_sized
from tablewright.sources import load_table

SPLIT = "spark.sql.files.maxPartitionBytes"


def sizes(path):
    return [os.path.getsize(f) for f in glob.glob(path.removeprefix("file:") + "/**/*.parquet", recursive=True)]


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get(SPLIT)
    spark.conf.set(SPLIT, "1m")
    yield
    spark.conf.set(SPLIT, before)


@pytest.mark.parametrize("keys", [(), ("hot",)])
def test_files_stay_within_the_bound(spark, small_splits, keys):
    events = load_table(spark, SF_ORACLE, "events").withColumn("hot", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id") % 5 + 1))
    bound = 64 << 10
    out = write_sized(events, fresh_path(spark, "sized"), bound, partition_by=keys)
    assert max(sizes(out)) <= bound
    assert sum(sizes(out)) > 2 * bound  # so there was something to cut
    back = spark.read.parquet(out).select(events.columns)
    assert back.exceptAll(events).count() == 0 and back.count() == events.count()


def test_small_outputs_are_few_files(spark):
    orders = load_table(spark, SF_ORACLE, "orders").repartition(40)
    out = write_sized(orders, fresh_path(spark, "sized"), 128 << 20, partition_by=["o_orderstatus"])
    assert len(sizes(out)) == 3
    assert len(sizes(write_sized(orders, fresh_path(spark, "sized"), 128 << 20))) == 1
    assert len(sizes(write_sized(orders.limit(0), fresh_path(spark, "sized"), 128 << 20))) <= 1


def test_the_stage_before_stays_wide_and_settings_come_back(spark):
    label = f"sized-{uuid.uuid4().hex}"
    before = {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.adaptive")}
    spark.sparkContext.setJobDescription(label)
    try:
        out = write_sized(spark.range(0, 10_000, 1, 24), fresh_path(spark, "sized"), 1 << 20)
    finally:
        spark.sparkContext.setJobDescription(None)
    assert len(sizes(out)) == 1
    assert {k: v for k, v in spark.conf.getAll.items() if k.startswith("spark.sql.adaptive")} == before
    log_dir = spark.conf.get("spark.eventLog.dir").replace("file:", "")
    for _ in range(100):
        events = read_events(log_dir)
        stages = {s for e in events if e["Event"] == "SparkListenerJobStart" and e.get("Properties", {}).get("spark.job.description") == label for s in e["Stage IDs"]}
        tasks = [e["Stage Info"]["Number of Tasks"] for e in events if e["Event"] == "SparkListenerStageCompleted" and e["Stage Info"]["Stage ID"] in stages]
        if len(tasks) >= 2:
            break
        time.sleep(0.2)
    assert sorted(tasks) == [1, 24]


def test_settings_come_back_after_a_failure(spark):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    with pytest.raises(RuntimeError):
        with sized(spark, 1000):
            assert spark.conf.get(name) == "600b"
            raise RuntimeError
    assert spark.conf.get(name) == before


def test_columns_of_any_type_and_clashing_names(spark, small_splits):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.create_map("id", F.lit("x")).alias("m"), F.col("id").alias("salt"), F.lit(None).alias("Salt_"))
    out = rebalance(df, 64 << 10, ["k"])
    assert out.columns == df.columns and out.count() == 100
    assert sorted(r.salt for r in out.collect()) == list(range(100))


def test_refused_bounds(spark):
    with pytest.raises(ValueError):
        rebalance(spark.range(1), 0)
    with pytest.raises(ValueError, match="at least"):
        rebalance(spark.range(1), 1000)
    both = {"output": {"path": "p", "max_file_bytes": 1 << 27}, "source": {"path": "x"}, "processing": {"max_partitions": 3}}
    with pytest.raises(ConfigError):
        run(spark, both)


def test_the_job_sizes_its_files(spark, small_splits):
    root = fresh_path(spark, "sized_runs")
    cfg = {"output": {"path": fresh_path(spark, "sized"), "max_file_bytes": 64 << 10}, "source": {"path": f"{SF_ORACLE}/orders.parquet"}, "run": {"root": root}}
    out = run(spark, cfg)
    assert max(sizes(cfg["output"]["path"])) <= 64 << 10 and len(sizes(cfg["output"]["path"])) > 1
    from tablewright.sinks import run_ledger

    assert run_ledger(spark, root).first().row_count == out.count() == 15000
