"""Where rows go: catalog tables (create if absent, append by name), files,
and write-once run folders published through a ledger."""

from tablewright.sinks.evolve import append_evolving, conform
from tablewright.sinks.files import write_files, write_sized
from tablewright.sinks.latest_state import update_latest
from tablewright.sinks.runs import (
    compact_ledger,
    is_published,
    latest_runs,
    observed,
    publish_run,
    read_latest_run,
    read_runs,
    record_run,
    run_ledger,
    unpublished_runs,
    write_run,
)
from tablewright.sinks.tables import (
    STREAM_WRITER,
    WRITER_PROPERTY,
    append,
    check_fit,
    column_ddl,
    create_table_if_absent,
    replace_partitions,
    table_properties,
)

__all__ = [
    "STREAM_WRITER",
    "WRITER_PROPERTY",
    "append",
    "append_evolving",
    "check_fit",
    "column_ddl",
    "compact_ledger",
    "conform",
    "create_table_if_absent",
    "is_published",
    "latest_runs",
    "observed",
    "publish_run",
    "read_latest_run",
    "read_runs",
    "record_run",
    "replace_partitions",
    "run_ledger",
    "table_properties",
    "unpublished_runs",
    "update_latest",
    "write_files",
    "write_run",
    "write_sized",
]
