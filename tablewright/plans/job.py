"""The table job: parameters in, rows appended to a catalog table or written to a path.

The config is read into a ``JobSpec`` before Spark is touched; then come the
target's name, the frame, the schema check, the DDL and the write. DDL and append
are separate commits: a failure between them leaves an empty table, which the next
run accepts. With ``run.root`` set, the run is recorded in that folder's ledger once
its rows are written; an id that the ledger has is refused before anything is written.
"""

from __future__ import annotations

from collections.abc import Mapping
from contextlib import nullcontext
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tablewright.config import JobSpec, config_sha256, make_run_id, reader_options
from tablewright.names import TableName, resolve_table
from tablewright.operators import cap_partitions, deduplicate, derive, filter_rows, rebalance, schema_check, sized, stamp_lineage
from tablewright.sinks import append, append_evolving, create_table_if_absent, is_published, observed, record_run, write_files
from tablewright.sources import range_source, read_files

# The original job's defaults. It generates ids 0 to 999
# (start 0, end 1000, exclusive), adds the column "double" = id * 2, and
# appends both bigint columns, "id" and "double", to one table.
DEFAULT_CONFIG: dict[str, Any] = {
    "table": {"name": "range_double"},
    "source": {"range": {"start": 0, "end": 1000}},
    "processing": {"derive": {"double": "id * 2"}},
}


class SchemaMismatch(ValueError):
    """The input does not have the columns that the config expects."""


def check_config(cfg: Mapping[str, Any]) -> JobSpec:
    """Everything that can be checked without Spark."""
    return JobSpec.of(cfg)


def target_table(spark: SparkSession, spec: JobSpec) -> TableName:
    return resolve_table(spark, spec.table, spec.catalog, spec.database)


def read_source(spark: SparkSession, spec: JobSpec) -> DataFrame:
    if spec.ids is not None:
        return range_source(spark, spec.ids.get("start", 0), spec.ids["end"], spec.ids.get("step", 1), spec.ids.get("partitions"))
    options = reader_options(spec.input_options)
    if spec.input_glob:
        options["pathGlobFilter"] = spec.input_glob
    return read_files(spark, spec.input_path, spec.input_format, spec.input_schema, **options)


def build_frame(spark: SparkSession, cfg: Mapping[str, Any] | JobSpec) -> DataFrame:
    spec = cfg if isinstance(cfg, JobSpec) else JobSpec.of(cfg)
    return transform(read_source(spark, spec), spec)


def transform(df: DataFrame, spec: JobSpec) -> DataFrame:
    """Filter, optional dedup, derived columns, partition cap; batch or stream."""
    if spec.predicate is not None:
        df = filter_rows(df, spec.predicate)
    if spec.dedup:
        df = deduplicate(df, spec.dedup_keys, spec.dedup_order)
    return cap_partitions(derive(df, spec.derived), spec.max_partitions)


def check_schema(df: DataFrame, spec: JobSpec) -> None:
    """Raise with every expected column that is missing or holds values of no such type."""
    if spec.expected is None:
        return
    wrong = [r for r in schema_check(df, spec.expected).collect() if r["actual"] is None or r["bad_rows"]]  # a row per expected column
    if wrong:
        raise SchemaMismatch("; ".join(f"{r['name']}: expected {r['expected']}, found {r['actual'] or 'no such column'}" + (f" with {r['bad_rows']} other values" if r["bad_rows"] else "") for r in wrong))


def run(spark: SparkSession, cfg: Mapping[str, Any]) -> DataFrame:
    """Run the job and return its target (all of it, read back)."""
    spec = JobSpec.of(cfg)
    target = target_table(spark, spec) if spec.table else None
    run_id = spec.run_id or make_run_id(cfg)
    if spec.runs_root and is_published(spark, spec.runs_root, run_id):
        raise ValueError(f"run {run_id} is already in the ledger of {spec.runs_root}; nothing was written")
    source = read_source(spark, spec)
    check_schema(source, spec)
    df = transform(source, spec)
    if spec.max_file_bytes:
        df = rebalance(df, spec.max_file_bytes)
    if spec.lineage:
        df = stamp_lineage(df, cfg, run_id=run_id)
    seen = None
    if spec.runs_root:
        df, seen = observed(df)
    with sized(spark, spec.max_file_bytes) if spec.max_file_bytes else nullcontext():
        if target is None:
            write_files(df, spec.output_path, fmt=spec.output_format)
        else:
            create_table_if_absent(spark, target, df.schema, spec.table_format, spec.location)
            append_evolving(df, target) if spec.evolve else append(df, target)
    if seen is not None:
        place = (target.dotted, "table", spec.table_format) if target else (spec.output_path, "path", spec.output_format)
        record_run(spark, spec.runs_root, run_id, spec.job, config_sha256(cfg), seen(), *place, note=spec.note, environment=spec.environment)
    return read_files(spark, spec.output_path, spec.output_format) if target is None else spark.table(target.quoted)
