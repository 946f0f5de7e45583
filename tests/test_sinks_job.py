"""Catalog table sink, file copies, session confs and the composed job."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from helpers import fresh, frame, rows
from tablewright.names import DATABASE_CONF, resolve_table
from tablewright.operators import double_id
from tablewright.plans.job import DEFAULT_CONFIG, run
from tablewright.session import fresh_path, fresh_table_suffix, shared_dir
from tablewright.sinks import append, create_table_if_absent, write_files
from tablewright.sources import range_source


def test_append_roundtrip(spark):
    name, loc = fresh(spark)
    df = frame(spark)
    create_table_if_absent(spark, name, df.schema, "parquet", loc)
    append(df, name)
    assert rows(spark.table(name.quoted)) == [(i, 2 * i) for i in range(1000)]


def test_append_is_not_idempotent(spark):
    name, loc = fresh(spark)
    df = frame(spark)
    for _ in range(2):
        create_table_if_absent(spark, name, df.schema, "parquet", loc)
        append(df, name)
    assert spark.table(name.quoted).count() == 2000


def test_append_matches_by_name_not_position(spark):
    name, loc = fresh(spark)
    df = frame(spark, 10)
    create_table_if_absent(spark, name, df.schema, "parquet", loc)
    append(df.select("double", "id"), name)
    assert rows(spark.table(name.quoted)) == [(i, 2 * i) for i in range(10)]


def test_append_missing_column_raises(spark):
    name, loc = fresh(spark)
    df = frame(spark, 10)
    create_table_if_absent(spark, name, df.schema, "parquet", loc)
    with pytest.raises(ValueError, match="missing"):
        append(df.select("id"), name)
    assert spark.table(name.quoted).count() == 0


def test_append_extra_column_raises(spark):
    name, loc = fresh(spark)
    df = frame(spark, 10)
    create_table_if_absent(spark, name, df.schema, "parquet", loc)
    with pytest.raises(ValueError, match="extra"):
        append(df.withColumn("z", F.lit(1)), name)


def test_append_to_missing_table_raises(spark):
    name, _ = fresh(spark)
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        append(frame(spark, 3), name)


def test_append_wrong_type_raises(spark):
    name, loc = fresh(spark)
    df = frame(spark, 3)
    create_table_if_absent(spark, name, df.schema, "parquet", loc)
    with pytest.raises(Exception):
        append(df.withColumn("id", F.lit("x")), name)


@pytest.mark.parametrize(
    "value, have, table",
    [("1.9", "double", "bigint"), ("1.55", "decimal(10,2)", "decimal(10,0)"), ("1", "bigint", "int"), ("1", "bigint", "double"), ("'x'", "string", "bigint"), ("array(1.5D)", "array<double>", "array<bigint>")],
)
def test_append_refuses_lossy_types(spark, value, have, table):
    name, loc = fresh(spark)
    create_table_if_absent(spark, name, StructType.fromDDL(f"v {table}"), "parquet", loc)
    with pytest.raises(ValueError, match="types do not fit"):
        append(spark.sql(f"SELECT CAST({value} AS {have}) AS v"), name)
    assert spark.table(name.quoted).count() == 0


@pytest.mark.parametrize("value, have, table", [("1", "int", "bigint"), ("1", "int", "double"), ("1.5", "decimal(4,1)", "decimal(10,2)"), ("7", "int", "decimal(12,2)"), ("1.5", "float", "double"), ("array(1)", "array<int>", "array<bigint>")])
def test_append_accepts_wider_targets(spark, value, have, table):
    name, loc = fresh(spark)
    create_table_if_absent(spark, name, StructType.fromDDL(f"v {table}"), "parquet", loc)
    append(spark.sql(f"SELECT CAST({value} AS {have}) AS v"), name)
    got = spark.table(name.quoted)
    assert got.selectExpr(f"v = CAST({value} AS {table}) AS same").first().same


def test_job_checks_the_expected_schema_before_it_writes(spark):
    src, out = fresh_path(spark, "inputs"), fresh_path(spark, "outputs")
    write_files(spark.createDataFrame([(1, "a"), (2, "7")], "id long, t string"), src)
    cfg = {"source": {"path": src}, "output": {"path": out}, "schema": {"expected": [["id", "bigint"], ["t", "int"], ["z", "int"]]}}
    with pytest.raises(ValueError, match="t: expected int, found string with 1 other values; z: expected int, found no such column"):
        run(spark, cfg)
    assert run(spark, {**cfg, "schema": {"expected": [["id", "bigint"]]}}).count() == 2


def test_job_records_its_run(spark):
    from tablewright.sinks import run_ledger

    root = fresh_path(spark, "runs")
    cfg = {**DEFAULT_CONFIG, "table": {"name": f"r_{fresh_table_suffix()}", "database": "default", "location": fresh_path(spark, "tables")}, "run": {"root": root, "lineage": True, "job": "nightly"}}
    got = run(spark, cfg)
    entry = run_ledger(spark, root).first()
    assert (entry.job, entry.row_count) == ("nightly", 1000) and entry.size_bytes > 1000 and int(entry.fingerprint) > 0
    assert {r.run_id for r in got.select("run_id").distinct().collect()} == {entry.run_id}


def test_create_if_absent_is_silent_noop_on_other_schema(spark):
    name, loc = fresh(spark)
    df = frame(spark, 3)
    create_table_if_absent(spark, name, df.schema, "parquet", loc)
    other = StructType([StructField("x", LongType())])
    create_table_if_absent(spark, name, other, "parquet", loc)
    assert spark.table(name.quoted).columns == ["id", "double"]


def test_create_rejects_odd_format(spark):
    name, loc = fresh(spark)
    with pytest.raises(ValueError):
        create_table_if_absent(spark, name, frame(spark, 1).schema, "parquet; DROP", loc)


def test_location_with_quote_is_escaped(spark):
    name, _ = fresh(spark)
    loc = fresh_path(spark, "tables") + "/it's"
    df = frame(spark, 3)
    create_table_if_absent(spark, name, df.schema, "parquet", loc)
    append(df, name)
    assert spark.table(name.quoted).count() == 3


def test_copy_files_roundtrip(spark):
    path = fresh_path(spark, "copies")
    write_files(frame(spark, 50), path)
    assert rows(spark.read.parquet(path)) == [(i, 2 * i) for i in range(50)]


def test_database_conf_is_required(spark):
    spark.conf.unset(DATABASE_CONF)
    with pytest.raises(RuntimeError, match=DATABASE_CONF):
        resolve_table(spark, "t")


def test_catalog_defaults_to_session_catalog(spark):
    spark.conf.set(DATABASE_CONF, "default")
    try:
        assert resolve_table(spark, "t").parts == ("spark_catalog", "default", "t")
    finally:
        spark.conf.unset(DATABASE_CONF)


def test_shared_dir_comes_from_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    assert fresh_path(spark, "x").startswith(shared_dir(spark) + "/x/")


def test_job_with_packaged_defaults_twice(spark):
    table = f"job_{fresh_table_suffix()}"
    spark.conf.set(DATABASE_CONF, "default")
    try:
        cfg = {**DEFAULT_CONFIG, "table": {"name": table, "location": fresh_path(spark, "tables")}}
        first = run(spark, cfg)
        assert rows(first) == [(i, 2 * i) for i in range(1000)]
        second = run(spark, cfg)
        assert second.count() == 2000
    finally:
        spark.conf.unset(DATABASE_CONF)


def test_job_without_database_fails_before_writing(spark):
    spark.conf.unset(DATABASE_CONF)
    with pytest.raises(RuntimeError):
        run(spark, {**DEFAULT_CONFIG, "table": {"name": f"nodb_{fresh_table_suffix()}"}})


def test_job_from_path_with_dedup_filter_and_cap(spark):
    src = fresh_path(spark, "inputs")
    data = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c")], "id long, t string")
    write_files(data, src)
    cfg = {
        "table": {"name": f"p_{fresh_table_suffix()}", "database": "default", "location": fresh_path(spark, "tables")},
        "source": {"path": src},
        "processing": {
            "filter": "id > 1",
            "enable_deduplication": True,
            "dedup_keys": ["t"],
            "dedup_order": ["id"],
            "derive": {"double": "id * 2"},
            "max_partitions": 2,
        },
    }
    out = run(spark, cfg)
    assert sorted(tuple(r) for r in out.collect()) == [(2, "a", 4), (3, "b", 6), (4, "c", 8)]
    assert len([f for f in spark.read.parquet(cfg["table"]["location"]).inputFiles()]) <= 2


def test_awkward_column_names_round_trip(spark):
    from tablewright.operators import schema_check

    name, loc = fresh(spark)
    df = spark.createDataFrame(
        [(1, (2, "x"), [3], {"k": 4})],
        "`we``ird col` bigint, `s t` struct<`a b`: int, `c`: string>, arr array<int>, m map<string,int>",
    )
    create_table_if_absent(spark, name, df.schema, "parquet", loc)
    append(df, name)
    back = spark.table(name.quoted)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert back.collect()[0]["s t"]["a b"] == 2
    check = schema_check(df, [("we`ird col", "bigint")]).collect()[0]
    assert (check.ok, check.bad_rows) == (True, 0)


def test_job_reads_csv_with_options(spark):
    src = fresh_path(spark, "inputs")
    write_files(frame(spark, 6), src, fmt="csv", header="true")
    cfg = {
        "table": {"name": f"csv_{fresh_table_suffix()}", "database": "default", "location": fresh_path(spark, "tables")},
        "source": {"path": src, "format": "csv", "options": {"header": True, "inferSchema": True}},
        "processing": {"derive": {"triple": "id * 3"}},
    }
    out = run(spark, cfg)
    assert out.columns == ["id", "double", "triple"]
    assert sorted((r.id, r.triple) for r in out.collect()) == [(i, 3 * i) for i in range(6)]


def test_source_options_checked_before_spark():
    cfg = {**DEFAULT_CONFIG, "source": {"path": "/x", "options": ["header"]}}
    with pytest.raises(SystemExit, match="source.options"):
        run(spark=None, cfg=cfg)


def test_load_config_from_a_file_and_run(spark):
    import hashlib
    import os
    import tomllib

    from tablewright import load_config

    folder = fresh_path(spark, "configs")
    os.makedirs(folder)
    text = (
        '[table]\nname = "cfg_' + fresh_table_suffix() + '"\ndatabase = "default"\n'
        '[source.range]\nstart = 0\nend = 10\n'
        '[processing]\nmax_partitions = 2\n[processing.derive]\ndouble = "id * 2"\n'
    )
    with open(f"{folder}/config.toml", "w") as fh:
        fh.write(text)
    cfg, meta = load_config(spark, f"{folder}/config.toml")
    assert cfg == tomllib.loads(text)
    assert meta["sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert rows(run(spark, cfg)) == [(i, 2 * i) for i in range(10)]


def test_load_config_errors(spark):
    import os
    import tomllib

    from tablewright import load_config

    folder = fresh_path(spark, "configs")
    os.makedirs(folder)
    with open(f"{folder}/bad.toml", "w") as fh:
        fh.write("[table\nname = ")
    with pytest.raises(tomllib.TOMLDecodeError):
        load_config(spark, f"{folder}/bad.toml")
    with pytest.raises(Exception):
        load_config(spark, f"{folder}/missing.toml")
    with open(f"{folder}/good.toml", "w") as fh:
        fh.write("x = 1")
    with pytest.raises(FileNotFoundError, match="one config file"):
        load_config(spark, folder)
    with open(f"{folder}/big.toml", "w") as fh:
        fh.write("x = 1\n" + "#" * (1 << 20))
    with pytest.raises(ValueError, match="more than a config file"):
        load_config(spark, f"{folder}/big.toml")


def test_concurrent_appends_to_one_table_keep_every_row(spark):
    """Without the per-table lock this lost rows, sometimes silently."""
    from concurrent.futures import ThreadPoolExecutor

    for _ in range(2):
        name, loc = fresh(spark)
        create_table_if_absent(spark, name, frame(spark, 1).schema, "parquet", loc)

        def one(i):
            append(double_id(range_source(spark, i * 1000, (i + 1) * 1000, num_partitions=4)), name)

        with ThreadPoolExecutor(max_workers=4) as pool:
            list(pool.map(one, range(4)))
        assert rows(spark.table(name.quoted)) == [(i, 2 * i) for i in range(4000)]
