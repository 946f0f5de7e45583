"""Upkeep of a run ledger: snapshots of its entries, and run folders that no entry names.

The ledger is one small file a run, so reading it opens as many files as there were runs.
``compact_ledger`` writes all entries into a few files under ``root/_snapshots``, and the newest of each
job beside them. From then on readers open the newest snapshot and the entries that it
does not have. The entries stay where they are: a run id is free only if there is no entry of it, and
runs published while a snapshot is written are simply not in it. A snapshot counts once its
mark is written after it, one file, so that one of a lost driver is never read.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SNAPSHOTS = "_snapshots"
#: Bytes of a snapshot's files at most, about.
FILE_BYTES = 64 << 20
#: Entries newer than the snapshot are read one by one up to this number; beyond, all entries are.
TAIL = 10_000


def _folder(root: str) -> str:
    return f"{root.rstrip('/')}/{SNAPSHOTS}"


def files_under(spark: SparkSession, path: str) -> DataFrame | None:
    """``path, length, modificationTime`` of the files under a folder or glob, none of them opened;
    None if there is no such folder. Names that start with ``_`` or ``.`` are not entered."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def part_of(path: str, key: str):
    """The value of the last ``key=value`` folder in a path."""
    return F.regexp_extract(path, f"^.*/{key}=([^/]+)/", 1)


def newest_snapshot(spark: SparkSession, root: str) -> str | None:
    """The folder of the snapshot marked last."""
    marks = files_under(spark, f"{_folder(root)}/marks")
    last = marks.agg(F.max(part_of("path", "snapshot"))).first()[0] if marks is not None else None
    return f"{_folder(root)}/{last}" if last else None


def write_snapshot(entries: DataFrame, newest: DataFrame, root: str) -> str:
    """Write a snapshot of ``entries``, with each job's ``newest`` beside them, and mark it. Returns its folder."""
    from tablewright.operators.partitions import sized
    from tablewright.sinks.files import write_files

    spark = entries.sparkSession
    name = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    path = f"{_folder(root)}/{name}"
    with sized(spark, FILE_BYTES):
        write_files(entries.orderBy("job", "published_at"), f"{path}/entries")
        write_files(newest.orderBy("job"), f"{path}/newest")
    write_files(spark.range(1).coalesce(1), f"{_folder(root)}/marks/snapshot={name}")
    return path


def read_with_tail(spark: SparkSession, root: str, ledger: str, schema: StructType, run_column: str, part: str) -> DataFrame:
    """The ``part`` of the newest snapshot with the entries under ``ledger`` that it does not have; all
    entries if there is no snapshot."""
    whole = spark.read.schema(schema).parquet(ledger)
    snapshot = newest_snapshot(spark, root)
    if snapshot is None:
        return whole
    known = spark.read.schema(schema).parquet(f"{snapshot}/entries").select(run_column)
    names = files_under(spark, ledger).select(part_of("path", run_column).alias(run_column)).distinct()
    tail = [r[0] for r in names.join(known, run_column, "left_anti").limit(TAIL + 1).collect()]  # at most TAIL + 1 ids
    if len(tail) > TAIL:
        return whole
    held = spark.read.schema(schema).parquet(f"{snapshot}/{part}")
    if not tail:
        return held
    fresh = spark.read.schema(schema).option("basePath", ledger).parquet(*[f"{ledger}/{run_column}={i}" for i in sorted(tail)])
    return held.unionByName(fresh)
