"""Write-once run folders and the published-run ledger."""

import pytest
from pyspark.sql import functions as F

from helpers import frame
from tablewright.session import fresh_path
from tablewright.sinks import read_runs, write_run


def test_write_run_is_write_once(spark):
    root = fresh_path(spark, "runs")
    write_run(frame(spark, 5), root, "20260101_000000-abcdef12")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        write_run(frame(spark, 5), root, "20260101_000000-abcdef12")


def test_read_runs_keeps_runs_apart(spark):
    root = fresh_path(spark, "runs")
    df = frame(spark, 5)
    write_run(df, root, "20260101_000000-aaaaaaaa")
    write_run(df.withColumn("double", F.col("double") + 1), root, "20260102_000000-bbbbbbbb")
    everything = read_runs(spark, root, df.schema, committed_only=False)
    assert everything.columns == ["id", "double", "run_id"]
    assert everything.count() == 10
    one = read_runs(spark, root, df.schema, run_id="20260102_000000-bbbbbbbb", committed_only=False)
    assert all("bbbbbbbb" in f for f in one.inputFiles())  # only that folder is listed
    assert read_runs(spark, root, df.schema, run_id="20260102_000000-bbbbbbbb").count() == 0  # not published
    assert sorted((r.id, r.double) for r in one.collect()) == [(i, 2 * i + 1) for i in range(5)]


def test_digit_run_id_stays_string(spark):
    root = fresh_path(spark, "runs")
    df = frame(spark, 2)
    write_run(df, root, "20260101")
    got = read_runs(spark, root, df.schema, committed_only=False)
    assert dict(got.dtypes)["run_id"] == "string"
    assert {r.run_id for r in got.collect()} == {"20260101"}


def test_run_id_must_be_a_folder_name(spark):
    with pytest.raises(ValueError):
        write_run(frame(spark, 1), fresh_path(spark, "runs"), "a/b")


def test_run_id_not_in_data(spark):
    with pytest.raises(ValueError):
        write_run(frame(spark, 1).withColumn("run_id", F.lit("x")), fresh_path(spark, "runs"), "r")


def test_publish_run_ledger_and_committed_reads(spark):
    from tablewright.sinks import latest_runs, publish_run, run_ledger

    root = fresh_path(spark, "runs")
    df = frame(spark, 7)
    entry = publish_run(df, root, "20260101_000000-aaaaaaaa", {"a": 1}, "job1")
    assert entry["row_count"] == 7 and entry["created_at"] == "20260101_000000"
    publish_run(df.limit(3), root, "20260102_000000-bbbbbbbb", {"a": 2}, "job1")
    publish_run(df, root, "20260101_120000-cccccccc", {"b": 1}, "job2")
    write_run(df, root, "20260105_000000-dddddddd")  # written, never published

    assert run_ledger(spark, root).count() == 3
    assert read_runs(spark, root, df.schema, committed_only=False).count() == 7 + 3 + 7 + 7  # the ledger folder is not data
    committed = read_runs(spark, root, df.schema)
    assert committed.count() == 7 + 3 + 7
    assert read_runs(spark, root, df.schema, run_id="20260105_000000-dddddddd", committed_only=True).count() == 0
    latest = {r.job: (r.run_id, r.row_count) for r in latest_runs(spark, root).collect()}
    assert latest == {"job1": ("20260102_000000-bbbbbbbb", 3), "job2": ("20260101_120000-cccccccc", 7)}


def test_read_latest_run(spark):
    from tablewright.sinks import publish_run, read_latest_run

    root = fresh_path(spark, "runs")
    df = frame(spark, 4)
    publish_run(df, root, "20260101_000000-aaaaaaaa", {}, "j")
    publish_run(df.withColumn("double", F.lit(-1).cast("bigint")), root, "20260102_000000-bbbbbbbb", {}, "j")
    got = read_latest_run(spark, root, df.schema, "j")
    assert {(r.double, r.run_id) for r in got.collect()} == {(-1, "20260102_000000-bbbbbbbb")}


def test_the_latest_run_is_the_one_published_last(spark):
    from tablewright.sinks import latest_runs, publish_run, read_latest_run

    root = fresh_path(spark, "runs")
    for value, run_id in enumerate(("20260101_000000-ffffffff", "20260101_000000-00000000", "20250101_000000-aaaaaaaa")):
        publish_run(frame(spark, 2).withColumn("double", F.lit(value).cast("bigint")), root, run_id, {}, "j")
        assert latest_runs(spark, root).first().run_id == run_id
    got = read_latest_run(spark, root, frame(spark, 1).schema, "j")
    assert {r.double for r in got.collect()} == {2} and all("aaaaaaaa" in f for f in got.inputFiles())
    assert read_latest_run(spark, root, frame(spark, 1).schema, "other").count() == 0


@pytest.mark.parametrize("run_id", ["nightly-9", "20260101", "20260101_000000-XYZ", "20260101_000000-aaaaaaaaa"])
def test_published_ids_have_the_release_form(spark, run_id):
    from tablewright.sinks import publish_run

    with pytest.raises(ValueError, match="run id"):
        publish_run(frame(spark, 1), fresh_path(spark, "runs"), run_id, {}, "j")


def test_ledger_counts_and_fingerprint_are_of_the_rows(spark):
    import hashlib

    from tablewright.sinks import publish_run

    entry = publish_run(frame(spark, 3), fresh_path(spark, "runs"), "20260101_000000-aaaaaaaa", {}, "j")
    texts = [f'{{"id":{i},"double":{2 * i}}}' for i in range(3)]
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert entry["size_bytes"] == sum(map(len, texts))
    assert int(entry["fingerprint"]) == sum(int(d[i : i + 8], 16) for d in digests for i in range(0, 64, 8))


def test_run_ids_that_would_hide_or_escape_are_rejected(spark):
    for bad in ("_x", ".x", "a=b", ""):
        with pytest.raises(ValueError):
            write_run(frame(spark, 1), fresh_path(spark, "runs"), bad)


def test_publishing_a_run_twice_fails_and_keeps_one_entry(spark):
    from tablewright.sinks import publish_run, run_ledger

    root = fresh_path(spark, "runs")
    publish_run(frame(spark, 2), root, "20260101_000000-aaaaaaaa", {}, "j")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        publish_run(frame(spark, 2), root, "20260101_000000-aaaaaaaa", {}, "j")
    assert run_ledger(spark, root).count() == 1


def test_ledger_records_versions(spark):
    import platform

    import tablewright
    from tablewright.sinks import publish_run, run_ledger

    root = fresh_path(spark, "runs")
    entry = publish_run(frame(spark, 2), root, "20260101_000000-aaaaaaaa", {}, "j")
    row = run_ledger(spark, root).collect()[0]
    assert (row.spark_version, row.package_version, row.python_version) == (
        spark.version,
        tablewright.__version__,
        platform.python_version(),
    )
    assert row.location == entry["location"] and row.run_id == "20260101_000000-aaaaaaaa"


def test_concurrent_publishers_under_one_root(spark):
    """Runs published at the same time (separate Spark jobs from threads)
    each land whole, and the ledger holds one entry per run."""
    from concurrent.futures import ThreadPoolExecutor

    from tablewright.sinks import publish_run, run_ledger

    root = fresh_path(spark, "runs")
    ids = [f"2026010{i}_000000-{i:08d}" for i in range(1, 5)]

    def publish(i_and_id):
        i, run_id = i_and_id
        return publish_run(frame(spark, 1000 * i), root, run_id, {"i": i}, "concurrent")

    with ThreadPoolExecutor(max_workers=4) as pool:
        entries = list(pool.map(publish, enumerate(ids, start=1)))
    assert [e["row_count"] for e in entries] == [1000, 2000, 3000, 4000]
    ledger = {r.run_id: r.row_count for r in run_ledger(spark, root).collect()}
    assert ledger == dict(zip(ids, [1000, 2000, 3000, 4000]))
    counts = {r.run_id: r["count"] for r in read_runs(spark, root, frame(spark, 1).schema, committed_only=True).groupBy("run_id").count().collect()}
    assert counts == ledger


def test_publishing_an_empty_run(spark):
    from tablewright.sinks import publish_run, run_ledger

    root = fresh_path(spark, "runs")
    entry = publish_run(frame(spark, 0), root, "20260101_000000-00000000", {}, "empty")
    assert entry["row_count"] == 0
    assert [r.row_count for r in run_ledger(spark, root).collect()] == [0]
    assert read_runs(spark, root, frame(spark, 1).schema, committed_only=True).count() == 0
