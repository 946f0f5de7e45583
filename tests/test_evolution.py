"""Appends whose rows differ from the table: nested rows are rewritten by name, lossy ones are refused."""

import pytest

from helpers import fresh
from tablewright.plans import run
from tablewright.session import fresh_path
from tablewright.sinks import append_evolving, conform, create_table_if_absent
from tablewright.sinks import write_files

TABLE = "id long, s struct<a: long, b: struct<c: double, d: string>>, l array<struct<x: long, y: string>>, m map<long, struct<v: double, w: string>>"


def made(spark, schema=TABLE):
    name, location = fresh(spark, "evolve")
    create_table_if_absent(spark, name, spark.createDataFrame([], schema).schema, "parquet", location)
    return name


def test_fill_widen_order_at_every_depth(spark):
    name = made(spark)
    whole = [(1, (2, (0.5, "d")), [(3, "y"), None], {4: (1.5, "w"), 5: None})]
    assert append_evolving(spark.createDataFrame(whole, TABLE), name) == []
    narrow = "M map<int, struct<W: string>>, l array<struct<y: string, x: smallint>>, s struct<b: struct<D: string>, a: int>, id int"
    rows = [({7: ("w",), 8: None}, [("y", 9), None], (("d",), 1), 2), (None, None, None, 3), ({}, [], (None, None), 4), ({1: (None,)}, [(None, None)], ((None,), None), 5)]
    assert append_evolving(spark.createDataFrame(rows, narrow), name) == []
    assert append_evolving(spark.createDataFrame([(6,)], "ID byte"), name) == []
    found = {r.id: (r.s, r.l, r.m) for r in spark.table(name.quoted).collect()}
    assert found == {
        1: ((2, (0.5, "d")), [(3, "y"), None], {4: (1.5, "w"), 5: None}),
        2: ((1, (None, "d")), [(9, "y"), None], {7: (None, "w"), 8: None}),
        3: (None, None, None),
        4: ((None, None), [], {}),
        5: ((None, (None, None)), [(None, None)], {1: (None, None)}),
        6: (None, None, None),
    }
    assert spark.table(name.quoted).schema == spark.createDataFrame([], TABLE).schema


def test_keys_of_maps_are_rewritten(spark):
    df = spark.createDataFrame([({(1, "a"): 1, (2, None): 2},)], "m map<struct<n: int, t: string>, int>")
    want = spark.createDataFrame([], "m map<struct<t: string, extra: int, n: long>, long>").schema
    assert conform(df, want).first().m == {("a", None, 1): 1, (None, None, 2): 2}


def test_new_columns_are_added(spark):
    name = made(spark, "id long")
    assert append_evolving(spark.createDataFrame([(1,)], "id int"), name) == []
    assert append_evolving(spark.createDataFrame([((1.5, [1]), 2, "x")], "`odd``name` struct<p: double, q: array<int>>, id int, t string"), name) == ["odd`name", "t"]
    assert append_evolving(spark.createDataFrame([(3, None)], "id int, T string"), name) == []
    assert sorted(map(tuple, spark.table(name.quoted).collect())) == [(1, None, None), (2, (1.5, [1]), "x"), (3, None, None)]


@pytest.mark.parametrize(
    "schema",
    [
        "id string",  # another type
        "id long, s struct<a: double>",  # a nested type that does not fit
        "id long, s struct<a: long, z: int>",  # a nested field without a place
        "id long, l array<struct<x: decimal(20,0)>>",
        "id long, l struct<x: long>",  # another kind
        "id long, m map<string, struct<v: double>>",
        "id long, m map<long, struct<v: string>>",
        "id long, s struct<a: long, A: long>",  # one name twice
        "id long, fresh void",
        "fine string, id timestamp",  # nothing is added either
    ],
)
def test_lossy_rows_are_refused_and_nothing_changes(spark, schema):
    name = made(spark)
    with pytest.raises(ValueError):
        append_evolving(spark.createDataFrame([], schema), name)
    assert spark.table(name.quoted).schema == spark.createDataFrame([], TABLE).schema
    assert spark.table(name.quoted).count() == 0


def test_empty_rows_and_missing_table(spark):
    name = made(spark)
    assert append_evolving(spark.createDataFrame([], "id long, extra int"), name) == ["extra"]
    assert spark.table(name.quoted).count() == 0
    other, _ = fresh(spark, "none")
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        append_evolving(spark.range(1), other)


def test_the_job_evolves_its_table_if_told(spark):
    name, location = fresh(spark, "evolving_job")
    paths = [write_files(df, fresh_path(spark, "evolving")) for df in (spark.range(3), spark.range(3, 5).selectExpr("cast(id AS int) AS id", "'x' AS note"))]
    cfg = {"table": {"name": name.table, "catalog": name.catalog, "database": name.database, "location": location}}
    run(spark, {**cfg, "source": {"path": paths[0]}})
    with pytest.raises(ValueError, match="extra"):
        run(spark, {**cfg, "source": {"path": paths[1]}})
    out = run(spark, {**cfg, "table": {**cfg["table"], "evolve": True}, "source": {"path": paths[1]}})
    assert sorted(map(tuple, out.collect())) == [(0, None), (1, None), (2, None), (3, "x"), (4, "x")]
