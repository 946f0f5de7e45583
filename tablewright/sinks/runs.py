"""Write-once run folders, published through a ledger.

A run is written to ``root/run_id=<id>``; a second write there fails. A
lost executor only re-runs its tasks, but a driver lost while committing
can leave a partly filled folder, and Spark's readers hide the ``_SUCCESS``
marker that would tell. So a run counts only once ``publish_run`` has
appended its ledger row to ``root/_runs`` after the write succeeded
(folders starting with ``_`` are skipped when the root is read as data).
The ledger is the per-run manifest; the latest run per job is one
``latest_per_key`` over it. Each entry is its own write-once folder, so
runs published at the same time do not share a committer folder. ``compact_ledger``
writes a snapshot, from which readers then open a few files whatever the number of runs.
"""

from __future__ import annotations

import platform
from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tablewright.config import RUN_FORM, RUN_ID, config_sha256
from tablewright.functions import digest_sum, row_text
from tablewright.names import quote_ident
from tablewright.operators.latest import latest_per_key
from tablewright.sinks.files import write_files
from tablewright.sinks.ledger import files_under, part_of, read_with_tail, write_snapshot

RUN_COLUMN = "run_id"


def package_version() -> str:
    from tablewright import __version__

    return __version__

LEDGER = "_runs"
# One ledger entry per run, in its own write-once folder
# ``_runs/run_id=<id>``: concurrent publishers never share a folder, and
# publishing the same run twice fails instead of adding a second row.
ENTRY_SCHEMA = StructType(
    [
        StructField("job", StringType(), False),
        StructField("created_at", StringType(), False),
        StructField("published_at", StringType(), False),
        StructField("config_sha256", StringType(), False),
        StructField("row_count", LongType(), False),
        StructField("size_bytes", LongType(), False),
        StructField("fingerprint", StringType(), False),
        StructField("location", StringType(), False),
        StructField("spark_version", StringType(), False),
        StructField("package_version", StringType(), False),
        StructField("python_version", StringType(), False),
        # where the rows are: a run folder, a path of their own, or a table
        StructField("kind", StringType(), True),
        StructField("format", StringType(), True),
        StructField("note", StringType(), True),
        StructField("environment", StringType(), True),
    ]
)
LEDGER_SCHEMA = StructType([*ENTRY_SCHEMA.fields, StructField(RUN_COLUMN, StringType(), True)])
FOLDER, PATH, TABLE = "folder", "path", "table"


def _check_run_id(run_id: str) -> str:
    if not run_id or "/" in run_id or "=" in run_id or run_id.startswith(("_", ".")):
        raise ValueError(f"invalid run id {run_id!r}")
    return run_id


def check_published_id(run_id: str) -> None:
    if not RUN_ID.fullmatch(run_id):
        raise ValueError(f"invalid run id {run_id!r}: not {RUN_FORM}")


def run_path(root: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/{RUN_COLUMN}={_check_run_id(run_id)}"


def ledger_path(root: str) -> str:
    return f"{root.rstrip('/')}/{LEDGER}"


def write_run(df: DataFrame, root: str, run_id: str, fmt: str = "parquet") -> str:
    """Write one run to ``root/run_id=<id>``; a second write there fails.

    The run id lives in the folder name only, so readers of ``root`` see it
    as a partition column and a filter on it prunes the other runs' files.
    """
    if RUN_COLUMN in df.columns:
        raise ValueError(f"{RUN_COLUMN} belongs in the path, not in the data")
    return write_files(df, run_path(root, run_id), fmt=fmt, mode="errorifexists")


def observed(df: DataFrame) -> tuple[DataFrame, Callable[[], dict[str, Any]]]:
    """``df``, and after it was written once: its row count, the bytes of its rows' JSON
    text, and the sum of all words of the rows' SHA-256."""
    seen = Observation()
    # columns of their own, so that the text and the digest are computed once a row
    text, digest = (_free_name(df, c) for c in ("row_text", "row_digest"))
    measured = df.withColumn(text, row_text(of=df)).withColumn(digest, F.sha2(text, 256))
    counted = measured.observe(
        seen,
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint").alias("size_bytes"),
        F.coalesce(F.sum(digest_sum(F.col(digest)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("fingerprint"),
    )
    return counted.select(*[F.col(quote_ident(c)) for c in df.columns]), lambda: dict(seen.get)


def _free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def record_run(
    spark: SparkSession,
    root: str,
    run_id: str,
    job: str,
    config_hash: str,
    seen: Mapping[str, Any],
    location: str,
    kind: str = FOLDER,
    fmt: str = "parquet",
    note: str | None = None,
    environment: str | None = None,
) -> dict[str, Any]:
    """Append a run's ledger row; its rows must have been written. Returns the row."""
    check_published_id(run_id)
    entry = {
        "job": job,
        RUN_COLUMN: run_id,
        "created_at": run_id.split("-", 1)[0],
        "published_at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ"),
        "config_sha256": config_hash,
        "row_count": int(seen["row_count"]),
        "size_bytes": int(seen["size_bytes"]),
        "fingerprint": str(seen["fingerprint"]),
        "location": location,
        "spark_version": spark.version,
        "package_version": package_version(),
        "python_version": platform.python_version(),
        "kind": kind,
        "format": fmt,
        "note": note,
        "environment": environment,
    }
    row = spark.createDataFrame([tuple(entry[f.name] for f in ENTRY_SCHEMA.fields)], ENTRY_SCHEMA)
    write_files(row.coalesce(1), run_path(ledger_path(root), run_id), mode="errorifexists")
    return entry


def publish_run(
    df: DataFrame,
    root: str,
    run_id: str,
    cfg: Mapping[str, Any],
    job: str,
    fmt: str = "parquet",
    note: str | None = None,
    environment: str | None = None,
) -> dict[str, Any]:
    """Write the run, then append its ledger row; returns that row.

    Counts and fingerprint are observed while writing (no second pass). The ledger row
    is appended only after the data commit succeeded, so a reader that
    trusts the ledger never sees a half-written run.
    """
    check_published_id(run_id)
    counted, seen = observed(df)
    path = write_run(counted, root, run_id, fmt)
    return record_run(df.sparkSession, root, run_id, job, config_sha256(cfg), seen(), path, fmt=fmt, note=note, environment=environment)


def run_ledger(spark: SparkSession, root: str) -> DataFrame:
    """Every published run's entry; ``run_id`` comes from the entry's folder."""
    return read_with_tail(spark, root, ledger_path(root), LEDGER_SCHEMA, RUN_COLUMN, "entries")


def compact_ledger(spark: SparkSession, root: str) -> str:
    """Write a snapshot of the ledger; returns its folder. Earlier snapshots are no longer read."""
    entries = run_ledger(spark, root)
    return write_snapshot(entries, latest_per_key(entries, ["job"], ["published_at", RUN_COLUMN]), root)


def unpublished_runs(spark: SparkSession, root: str) -> DataFrame:
    """``run_id, n_files, size_bytes, last_modified`` of the run folders under ``root`` that no ledger
    entry names: runs being written, or left by a lost driver (also what it had not committed yet).

    Only names are listed, no file is opened but the ledger's. A folder without any file holds nothing and has no row.
    Nothing is deleted; choose by ``last_modified``, as a run being written looks the same.
    """
    runs = f"{root.rstrip('/')}/{RUN_COLUMN}=*"
    # a job's uncommitted files lie in hidden folders, which listings enter only if they are named
    places = [files_under(spark, runs + hidden) for hidden in ("", "/_temporary/*", "/_temporary/*/_temporary/*")]
    empty = spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    files = empty
    for found in places:
        files = files if found is None else files.unionByName(found)
    by_run = files.groupBy(part_of("path", RUN_COLUMN).alias(RUN_COLUMN)).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("size_bytes"), F.max("modificationTime").alias("last_modified")
    )
    if files_under(spark, ledger_path(root)) is None:
        return by_run
    named = run_ledger(spark, root).filter(F.coalesce(F.col("kind"), F.lit(FOLDER)) == FOLDER).select(RUN_COLUMN)
    return by_run.join(named, RUN_COLUMN, "left_anti")


def latest_runs(spark: SparkSession, root: str) -> DataFrame:
    """Ledger row of the run published last, per job."""
    newest = read_with_tail(spark, root, ledger_path(root), LEDGER_SCHEMA, RUN_COLUMN, "newest")
    return latest_per_key(newest, ["job"], ["published_at", RUN_COLUMN])


def is_published(spark: SparkSession, root: str, run_id: str) -> bool:
    """Whether the run has its ledger row; only that entry's folder is looked at."""
    try:
        return bool(spark.read.schema(ENTRY_SCHEMA).parquet(run_path(ledger_path(root), run_id)).head(1))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def _with_run(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField(RUN_COLUMN, StringType(), True)])


def _one_run(spark: SparkSession, root: str, schema: StructType, run_id: str, fmt: str) -> DataFrame:
    """A run's rows; only its folder is listed."""
    return spark.read.format(fmt).schema(_with_run(schema)).option("basePath", root).load(run_path(root, run_id))


def _elsewhere(spark: SparkSession, schema: StructType, run_id: str, kind: str, location: str, fmt: str) -> DataFrame:
    """The rows of a run that its ledger row finds in a path or a table of their own."""
    names = [f.name for f in schema.fields if f.name.lower() != RUN_COLUMN]
    if kind == PATH:
        rows = spark.read.format(fmt).load(location)
    else:
        rows = spark.table(".".join(map(quote_ident, location.split("."))))
        if RUN_COLUMN not in rows.columns:
            raise ValueError(f"the rows of run {run_id} in {location} cannot be told from other runs': its job did not stamp them (run.lineage)")
    if RUN_COLUMN in rows.columns:
        rows = rows.filter(F.col(RUN_COLUMN) == run_id)
    return rows.select(*[F.col(quote_ident(c)) for c in names], F.lit(run_id).alias(RUN_COLUMN))


def _entry_rows(spark: SparkSession, root: str, schema: StructType, entry: Mapping[str, Any], fmt: str) -> DataFrame:
    if entry["kind"] in (None, FOLDER):
        return _one_run(spark, root, schema, entry[RUN_COLUMN], entry["format"] or fmt)
    return _elsewhere(spark, schema, entry[RUN_COLUMN], entry["kind"], entry["location"], entry["format"] or fmt)


def read_runs(
    spark: SparkSession,
    root: str,
    schema: StructType,
    run_id: str | None = None,
    fmt: str = "parquet",
    committed_only: bool = True,
) -> DataFrame:
    """All published runs under ``root`` (or one), with ``run_id`` as a string column last.

    The schema is given rather than inferred, so an id made of digits stays
    a string and no file footers are sampled. Runs are read where their ledger rows say: folders
    under ``root``, and the paths and tables that jobs wrote. With ``committed_only=False`` run folders
    without a ledger row, which may be half written, are read too.
    """
    full = _with_run(schema)
    if run_id is not None:
        if not committed_only:
            return _one_run(spark, root, schema, run_id, fmt)
        if not is_published(spark, root, run_id):
            return spark.createDataFrame([], full)
        own = spark.read.schema(ENTRY_SCHEMA).parquet(run_path(ledger_path(root), run_id)).first()
        return _entry_rows(spark, root, schema, {**own.asDict(), RUN_COLUMN: run_id}, fmt)
    df = spark.read.format(fmt).schema(full).load(root)
    if committed_only:
        ledger = run_ledger(spark, root)
        df = df.join(ledger.select(RUN_COLUMN).distinct(), RUN_COLUMN, "left_semi").select(*full.fieldNames())
        # a job's own places: a row per run that was recorded, not written, under the root
        for entry in ledger.filter(F.col("kind").isin(PATH, TABLE)).toLocalIterator():
            df = df.unionByName(_entry_rows(spark, root, schema, entry.asDict(), fmt))
    return df


def read_latest_run(spark: SparkSession, root: str, schema: StructType, job: str, fmt: str = "parquet") -> DataFrame:
    """Rows of the run of ``job`` that was published last, from where its ledger row says;
    nothing else is listed. No rows if the job has no published run."""
    last = latest_runs(spark, root).filter(F.col("job") == job).first()  # one row
    return _entry_rows(spark, root, schema, last.asDict(), fmt) if last else spark.createDataFrame([], _with_run(schema))
