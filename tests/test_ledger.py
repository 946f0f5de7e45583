"""Snapshots of a run ledger, and run folders that it does not name."""

import pathlib

import pytest

from tablewright.session import fresh_path
from tablewright.sinks import compact_ledger, latest_runs, publish_run, read_latest_run, read_runs, run_ledger, unpublished_runs, write_run
from tablewright.sinks import ledger as upkeep
from tablewright.sinks.runs import ledger_path


def run_id(i):
    return f"2026010{i}_000000-0000000{i}"


def publish(spark, root, i, job="a"):
    publish_run(spark.range(i), root, run_id(i), {}, job)


def local(path):
    return pathlib.Path(path.removeprefix("file:"))


def spoil(root, ids):
    """Entries that nobody may open any more."""
    for i in ids:
        for f in local(ledger_path(root)).glob(f"run_id={run_id(i)}/*.parquet"):
            f.write_bytes(b"not parquet")
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)


def test_entries_in_a_snapshot_are_not_opened(spark):
    root, schema = fresh_path(spark, "ledgers"), spark.range(0).schema
    for i, job in ((1, "a"), (2, "b"), (3, "a")):
        publish(spark, root, i, job)
    before = sorted(map(tuple, run_ledger(spark, root).collect()))
    compact_ledger(spark, root)
    spoil(root, (1, 2, 3))
    assert sorted(map(tuple, run_ledger(spark, root).collect())) == before
    assert read_latest_run(spark, root, schema, "a").count() == 3
    assert read_latest_run(spark, root, schema, "b").count() == 2
    assert read_latest_run(spark, root, schema, "none").count() == 0
    publish(spark, root, 4, "b")  # the tail
    assert {(r.job, r.run_id) for r in latest_runs(spark, root).collect()} == {("a", run_id(3)), ("b", run_id(4))}
    assert read_runs(spark, root, schema).count() == 10
    compact_ledger(spark, root)  # from the snapshot before and the tail
    spoil(root, (4,))
    assert {r.run_id: r.row_count for r in run_ledger(spark, root).collect()} == {run_id(i): i for i in (1, 2, 3, 4)}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):  # ids stay taken
        publish(spark, root, 4)


def test_unmarked_snapshots_do_not_count(spark):
    root = fresh_path(spark, "ledgers")
    publish(spark, root, 1)
    path = compact_ledger(spark, root)
    publish(spark, root, 2)
    later = local(path).with_name("99990101T000000000000-00000000") / "entries"
    later.mkdir(parents=True)
    (later / "part-0.parquet").write_bytes(b"half")
    assert upkeep.newest_snapshot(spark, root) == path
    assert run_ledger(spark, root).count() == 2


def test_a_long_tail_reads_all_entries(spark, monkeypatch):
    root = fresh_path(spark, "ledgers")
    publish(spark, root, 1)
    compact_ledger(spark, root)
    for i in (2, 3):
        publish(spark, root, i)
    monkeypatch.setattr(upkeep, "TAIL", 1)
    assert {r.run_id for r in run_ledger(spark, root).collect()} == {run_id(i) for i in (1, 2, 3)}
    assert latest_runs(spark, root).first().run_id == run_id(3)


def test_unpublished_folders_are_listed_exactly(spark):
    root = fresh_path(spark, "ledgers")
    assert unpublished_runs(spark, root).count() == 0  # nothing there at all
    write_run(spark.range(5).repartition(2), root, run_id(1))
    assert [r.run_id for r in unpublished_runs(spark, root).collect()] == [run_id(1)]  # no ledger yet
    publish(spark, root, 2)
    # a lost driver's uncommitted files, beside nothing else
    hidden = local(root) / f"run_id={run_id(3)}" / "_temporary" / "0"
    for folder in ("task_1_m_0", "_temporary/attempt_1_m_1"):
        (hidden / folder).mkdir(parents=True)
        (hidden / folder / "part-00000.parquet").write_bytes(b"12345")
    (local(root) / f"run_id={run_id(4)}").mkdir()  # holds nothing
    for _ in range(2):
        found = {r.run_id: (r.n_files, r.size_bytes) for r in unpublished_runs(spark, root).collect()}
        assert found.keys() == {run_id(1), run_id(3)}
        assert found[run_id(3)] == (2, 10) and found[run_id(1)][0] == 2
        assert found[run_id(1)][1] == sum(f.stat().st_size for f in local(root).glob(f"run_id={run_id(1)}/*.parquet"))
        compact_ledger(spark, root)
