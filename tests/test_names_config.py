"""Targets and job descriptions: what a config means, and what is refused before Spark is used."""

import hashlib
import json
import re

import pytest

from tablewright.config import ConfigError, JobSpec, config_sha256, make_run_id
from tablewright.names import CATALOG_CONF, DATABASE_CONF, TableName, resolve_table
from tablewright.plans.job import DEFAULT_CONFIG, run

SOURCE = {"path": "/in"}
JOB = {"table": {"name": "t"}, "source": SOURCE}


def test_a_minimal_job_has_the_documented_defaults():
    spec = JobSpec.of(JOB)
    assert (spec.table, spec.input_path, spec.input_format, spec.table_format) == ("t", "/in", "parquet", "parquet")
    assert (spec.dedup, spec.derived, spec.max_partitions, spec.expected, spec.ids) == (False, {}, None, None, None)


def test_null_values_and_foreign_keys_change_nothing():
    extra = {"table": {"name": "t", "format": None, "owner": "me"}, "source": SOURCE, "team": {"name": "x"}, "processing": None}
    assert JobSpec.of(extra) == JobSpec.of(JOB)


def test_the_default_job_counts_to_a_thousand():
    assert dict(JobSpec.of(DEFAULT_CONFIG).ids) == {"start": 0, "end": 1000}


def test_a_path_instead_of_a_table():
    spec = JobSpec.of({"output": {"path": "/out"}, "source": SOURCE})
    assert spec.table is None and spec.output_path == "/out"


REFUSED = [
    ({}, "table.name"),
    ({"source": SOURCE}, "table.name, output.path"),
    ({**JOB, "output": {"path": "/out"}}, "exactly one of table.name, output.path"),
    ({"table": {"name": "t"}}, "source.path, source.range"),
    ({"table": {"name": "t"}, "source": {"path": "/in", "range": {"end": 3}}}, "exactly one of source.path"),
    ({"table": "t", "source": SOURCE}, "table must be a table"),
    ({"table": {"name": "a-b"}, "source": SOURCE}, "table.name"),
    ({"table": {"name": "t", "database": "x y"}, "source": SOURCE}, "table.database"),
    ({"table": {"name": "t", "format": "parquet; x"}, "source": SOURCE}, "table.format"),
    ({"table": {"name": "t", "location": 5}, "source": SOURCE}, "table.location"),
    ({"table": {"name": "t"}, "source": {"range": 1000}}, "source.range"),
    ({"table": {"name": "t"}, "source": {"range": {"start": 0}}}, "source.range"),
    ({"table": {"name": "t"}, "source": {"path": ""}}, "source.path"),
    ({"table": {"name": "t"}, "source": {"path": "/in", "options": "header"}}, "source.options"),
    *[({**JOB, "processing": {"max_partitions": n}}, "max_partitions") for n in (0, -1, "200", True, 1.5)],
    *[({**JOB, "processing": p}, next(iter(p))) for p in ({"derive": {"x": 3}}, {"derive": ["x"]}, {"dedup_keys": "text"}, {"dedup_order": [1]}, {"filter": 5}, {"enable_deduplication": "yes"})],
    *[({**JOB, "schema": {"expected": e}}, "schema.expected") for e in ("id bigint", [["id"]], [["id", 3]])],
    ({**JOB, "run": {"lineage": "on"}}, "run.lineage"),
    ({**JOB, "streaming": {"max_files_per_trigger": 0}}, "max_files_per_trigger"),
]


@pytest.mark.parametrize("cfg, says", REFUSED)
def test_refused_before_spark_is_used(cfg, says):
    with pytest.raises(ConfigError, match=re.escape(says)):
        run(spark=None, cfg=cfg)
    assert issubclass(ConfigError, SystemExit)


@pytest.fixture
def confs(spark):
    yield spark.conf
    for key in (CATALOG_CONF, DATABASE_CONF):
        spark.conf.unset(key)


def test_a_target_takes_each_part_from_the_job_then_the_session(spark, confs):
    with pytest.raises(RuntimeError, match="database"):
        resolve_table(spark, "t")
    confs.set(DATABASE_CONF, "db")
    assert resolve_table(spark, "t") == TableName("spark_catalog", "db", "t")
    confs.set(CATALOG_CONF, "lake")
    assert resolve_table(spark, "t").dotted == "lake.db.t"
    assert resolve_table(spark, "t", database="own").dotted == "lake.own.t"
    assert resolve_table(spark, "t", "c", "own").quoted == "`c`.`own`.`t`"
    confs.set(DATABASE_CONF, "d b")
    with pytest.raises(ValueError, match="database"):
        resolve_table(spark, "t")


def test_names_survive_quoting():
    name = TableName("a", "b_1", "C2")
    assert TableName.parse(name.quoted) == TableName.parse(name.dotted) == name
    for text in ("b.c", "a.b.c.d", "a.b-c.d", "a..c"):
        with pytest.raises(ValueError):
            TableName.parse(text)


def test_the_config_digest_is_of_its_canonical_json():
    cfg = {"b": {"d": 3, "c": [1, "x"]}, "a": 1}
    assert config_sha256(cfg) == hashlib.sha256(json.dumps(cfg, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert config_sha256({"a": 1}) != config_sha256({"a": "1"})


def test_run_ids_hold_the_start_and_the_digest():
    assert make_run_id({"a": 1}, "20260101_000000") == f"20260101_000000-{config_sha256({'a': 1})[:8]}"
    assert re.fullmatch(r"\d{8}_\d{6}-[0-9a-f]{8}", make_run_id({}))
