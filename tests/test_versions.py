"""Digest trees, the latest-row state, sketches."""

import pathlib

import pytest
from pyspark.sql import functions as F

from helpers import fresh, frame
from tablewright.operators import compare, estimates, latest_per_key, manifest_sketches, merge_sketches, write_digested
from tablewright.operators.compare import FAN, differing_leaves, digests
from tablewright.session import fresh_path
from tablewright.sinks import update_latest
from tablewright.sinks.latest_state import KEY, _version, current_version, merged

ROWS = "id bigint, v string, m map<string,int>"


def versions(spark, old, new, width=10):
    paths = [write_digested(spark.createDataFrame(r, ROWS), fresh_path(spark, "versions"), "id", width) for r in (old, new)]
    schema = spark.createDataFrame([], ROWS).schema
    return paths, {r.id: r.change for r in compare(spark, *paths, schema, "id", width).collect()}


def test_changes_of_every_kind(spark):
    old = [(i, f"v{i}", {"a": i, "b": 1}) for i in range(3000)] + [(None, "x", None), (7, "twice", None), (-5, "n", None), (-700, None, None)]
    new = [(i, f"v{i}" if i != 11 else "w", {"b": 1, "a": i}) for i in range(3000) if i != 2999] + [(None, "y", None), (7, "twice", None), (7, "twice", None), (10**12, "far", None), (-5, "n", None), (-700, None, {})]
    paths, found = versions(spark, old, new)
    assert found == {11: "changed", 2999: "removed", None: "changed", 7: "changed", 10**12: "added", -700: "changed"}
    assert {r.node for r in differing_leaves(spark, *paths).collect()} == {1, 299, 0, 10**11, -70, -(1 << 62)}
    assert compare(spark, paths[0], paths[0], spark.createDataFrame([], ROWS).schema, "id", 10).count() == 0


def test_empty_and_short_trees(spark):
    assert versions(spark, [], [])[1] == {}
    assert versions(spark, [], [(1, "a", None)])[1] == {1: "added"}
    assert versions(spark, [(i, "a", None) for i in range(2000)], [(3, "a", None)])[1] == {i: "removed" for i in range(2000) if i != 3}


def test_equal_ranges_are_not_read(spark):
    """Blocks without a difference may even be unreadable."""
    width, n = 4, 4 * FAN * 6
    old = frame(spark, n)
    new = old.withColumn("double", F.when(F.col("id") == 5, -1).otherwise(F.col("double")))
    paths = [write_digested(df, fresh_path(spark, "versions"), "id", width) for df in (old, new)]
    spoilt = 0
    for path in paths:
        for block in pathlib.Path(path).glob("key_block=*"):
            if block.name != "key_block=0":
                for f in block.glob("*.parquet"):
                    f.write_bytes(b"spoilt")
                    spoilt += 1
                for f in block.glob(".*.crc"):
                    f.unlink()
    assert spoilt >= 10
    assert [tuple(r) for r in compare(spark, *paths, old.schema, "id", width).collect()] == [(5, "changed")]


def test_digests_add_up(spark):
    path = write_digested(frame(spark, 5000), fresh_path(spark, "versions"), "id", 3)
    sums = [tuple(digests(spark, path, level).agg(F.sum("row_count"), F.sum("digest")).first()) for level in range(2)]
    assert sums[0][0] == 5000 and len(set(sums)) == 1


def state_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_state_equals_the_latest_of_all_runs(spark):
    schema = "k string, n int, o int, v string"
    runs = [[("a", 1, 1, "x"), ("a", 1, 2, "y"), (None, 1, 5, "n"), ("b", None, None, "z")], [("a", 1, 2, "z"), ("a", 2, 0, None), (None, 1, 4, "m"), ("b", None, 0, "w")], [], [("a", 1, 1, "late"), ("c", 3, 3, "c"), ("b", None, None, "zz")]]
    name, _ = fresh(spark, "state")
    seen = []
    for i, rows in enumerate(runs):
        seen += rows
        df = spark.createDataFrame(rows, schema)
        for _ in range(2):  # applying a run twice changes nothing
            state = update_latest(spark, name, df, ["k", "n"], ["o"], buckets=4)
            assert state.columns == ["k", "n", "o", "v"]
            assert state_rows(state) == state_rows(latest_per_key(spark.createDataFrame(seen, schema), ["k", "n"], ["o"]))
    assert current_version(spark, name) == 2 * len(runs)
    assert not spark.catalog.tableExists(_version(name, 1).quoted)


def test_the_state_side_is_not_shuffled(spark):
    name, _ = fresh(spark, "state")
    rows = spark.range(5000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("o"))
    update_latest(spark, name, rows, ["k"], ["o"], buckets=8)
    state = spark.table(_version(name, 1).quoted)
    news = latest_per_key(spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("o")), ["k"], ["o"]).withColumn(KEY, F.to_json(F.struct("k")))
    plan = merged(state, news.select(*state.columns), ["o"])._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("SortMergeJoin") :]
    scan = left.index("FileScan parquet")
    assert "Exchange" not in left[:scan] and "Bucketed: true" in left[scan:]


def test_state_refuses_other_tables_and_columns(spark):
    name, _ = fresh(spark, "state")
    update_latest(spark, name, frame(spark, 3), ["id"], ["double"], buckets=2)
    with pytest.raises(ValueError, match="columns do not match"):
        update_latest(spark, name, frame(spark, 3).withColumn("more", F.lit(1)), ["id"], ["double"], buckets=2)
    with pytest.raises(ValueError, match=KEY):
        update_latest(spark, name, frame(spark, 3).withColumn(KEY, F.lit("x")), ["id"], ["double"])


def test_sketches_merge_and_stay_within_bounds(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7001).alias("d"), F.col("id").cast("double").alias("x"))
    df = df.unionByName(spark.sql("select 9L g, cast(null as bigint) d, cast(null as double) x"))
    parts = [manifest_sketches(df.filter(f"id_part = {i}"), ["g"], "d", "x") for df in [df.withColumn("id_part", F.coalesce(F.col("x").cast("long") % 4, F.lit(0)))] for i in range(4)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    found = {r.g: r for r in estimates(merge_sketches(whole, ["g"]), (0.0, 0.25, 0.5, 1.0)).collect()}
    for g in range(3):
        assert found[g].row_count == 20_000 and abs(found[g].distinct_count - 7001) < 0.05 * 7001
        assert found[g].quantiles[0] == g and found[g].quantiles[3] == 59_997 + g
        assert all(abs(q / 60_000 - r) < 0.02 for q, r in zip(found[g].quantiles[1:3], (0.25, 0.5)))
    assert (found[9].row_count, found[9].distinct_count, found[9].quantiles) == (1, 0, [None] * 4)
    assert estimates(manifest_sketches(df.limit(0), ["g"], "d", "x")).collect() == []
