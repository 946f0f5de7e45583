"""The table job, run incrementally.

A batch append is not idempotent: running it twice stores its rows twice.
Reading the input folder as a file stream and writing with a checkpoint
makes each input file land in the table once, however often the
job is started with that checkpoint, and a lost executor only re-runs its tasks. With an
``availableNow`` trigger the job processes what is there and stops, so it
schedules like a batch job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tablewright.config import ConfigError, JobSpec, make_run_id, reader_options
from tablewright.names import TableName, quote_ident, resolve_table
from tablewright.operators import filter_rows, misfits, stamp_lineage
from tablewright.plans.job import transform
from tablewright.session import CHECKPOINT_CONF
from tablewright.sinks import STREAM_WRITER, WRITER_PROPERTY, check_fit, create_table_if_absent, replace_partitions, table_properties


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    fmt: str = "parquet",
    glob: str | None = None,
    max_files_per_trigger: int | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """New files of ``folder`` (optionally matching ``glob``) as a stream.

    ``options`` go to the reader as they are; for large folders the file
    source's ``maxFileAge`` and ``latestFirst`` bound what each listing considers.
    """
    reader = spark.readStream.format(fmt).schema(schema).options(**(options or {}))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.load(folder)


# Table properties that bind a table to the one stream that may fill it. The file sink
# skips batch numbers that the table's log already has, and a new checkpoint counts
# from 0 again, so rows of a second checkpoint or source would be lost without an error.
CHECKPOINT_PROPERTY = "tablewright.checkpoint"
SOURCE_PROPERTY = "tablewright.source"


def append_stream(df: DataFrame, name: TableName, checkpoint: str) -> StreamingQuery:
    """Append a stream to an existing table, by name; each input file once, as long as
    every start uses the same checkpoint and source."""
    target = df.sparkSession.table(name.quoted).schema
    check_fit(df.schema, target, name)
    by_lower = {c.lower(): c for c in df.columns}
    fitted = [F.col(quote_ident(by_lower[f.name.lower()])).cast(f.dataType).alias(f.name) for f in target.fields]
    return (
        df.select(*fitted).writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .toTable(name.quoted)
    )


def _checkpoint(spark: SparkSession, spec: JobSpec, target: TableName) -> str:
    """The config's checkpoint, else one per table in the folder that the cluster names;
    never a folder that the next start would not find."""
    if spec.checkpoint:
        return spec.checkpoint.rstrip("/")
    shared = spark.conf.get(CHECKPOINT_CONF, "")
    if not shared:
        raise ConfigError(f"invalid config: set streaming.checkpoint, or {CHECKPOINT_CONF} in the session")
    return f"{shared.rstrip('/')}/streams/{target.dotted}"


def first_arrivals(df: DataFrame, keys: Sequence[str], horizon: str) -> DataFrame:
    """The first row of each key to arrive. A key is remembered for ``horizon`` after its first row; one that comes
    back later is new again, so the state holds the keys of one horizon and not the whole history.
    Time is that of the batch that brings a row, so no row comes too late. Which of several rows of one batch
    stays is open; null keys are a key."""
    arrived = "arrived"
    while arrived in df.columns:
        arrived += "_"
    timed = df.withColumn(arrived, F.current_timestamp()).withWatermark(arrived, horizon)
    return timed.dropDuplicatesWithinWatermark(list(keys)).drop(arrived)


BATCH_COLUMN, REASONS = "batch_id", "misfits"


def append_batches(stream: DataFrame, spec: JobSpec, prepare, target: TableName, quarantine: TableName, checkpoint: str) -> StreamingQuery:
    """Append each batch of a stream in two parts: what fits the expected types goes through ``prepare`` into ``target``,
    the other rows, as they came and with the names of the columns that do not fit, into ``quarantine``. Both
    tables are partitioned by the batch's number and a batch replaces its own partitions, so
    one that failed halfway and is run again leaves each row once."""

    def write(batch: DataFrame, number: int) -> None:
        told = batch.withColumn(REASONS, misfits(batch, spec.expected)).persist()
        try:
            for df, name in ((prepare(told.filter(F.size(REASONS) == 0).drop(REASONS)), target), (told.filter(F.size(REASONS) > 0), quarantine)):
                replace_partitions(df.withColumn(BATCH_COLUMN, F.lit(number).cast("bigint")), name)
        finally:
            told.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _check_incremental(spec: JobSpec) -> None:
    """Refuse what the incremental job would otherwise ignore."""
    if not spec.table or not spec.input_path:
        raise ConfigError("invalid config: the incremental job needs table.name and source.path")
    if spec.evolve or spec.max_file_bytes:
        raise ConfigError("invalid config: table.evolve and output.max_file_bytes are the batch job's")
    if spec.runs_root:
        raise ConfigError("invalid config: run.root is the batch job's; the incremental job's record is its checkpoint")
    if spec.dedup and not (spec.dedup_keys and spec.horizon):
        raise ConfigError("invalid config: processing.enable_deduplication needs processing.dedup_keys and streaming.horizon here, or the batch job")
    if spec.dedup and spec.dedup_order:
        raise ConfigError("invalid config: processing.dedup_order needs the batch job; a stream keeps the first row to arrive")
    if spec.expected is not None and not spec.quarantine:
        raise ConfigError("invalid config: schema.expected needs schema.quarantine here, a table for the rows that do not fit")
    if spec.dedup and spec.expected is not None:
        raise ConfigError("invalid config: schema.quarantine and processing.enable_deduplication need two jobs, one after the other")


def run_incremental(spark: SparkSession, cfg: Mapping[str, Any]) -> DataFrame:
    """The job with ``source.path`` read as a stream; returns the target table.

    A second start resumes where the first stopped. Keyed deduplication keeps the first row to
    arrive within ``streaming.horizon``. With ``schema.expected``, rows that do not fit go to the table
    ``schema.quarantine``, and both tables have the batch's number as a column. The target table belongs to the incremental
    job and to one checkpoint and source (table properties): a table without them, or
    with others, is refused, and batch ``append`` refuses tables with them.
    """
    spec = JobSpec.of(cfg)
    _check_incremental(spec)
    target = resolve_table(spark, spec.table, spec.catalog, spec.database)
    checkpoint = _checkpoint(spark, spec, target)
    options = reader_options(spec.input_options)
    schema = spec.input_schema
    if schema is None:
        # Schema from the files, read once on the driver from their footers.
        reader = spark.read.format(spec.input_format).options(**options)
        if spec.input_glob:
            reader = reader.option("pathGlobFilter", spec.input_glob)
        schema = reader.load(spec.input_path).schema
    elif isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    stream = read_stream(spark, spec.input_path, schema, spec.input_format, spec.input_glob, spec.max_files, options)
    run_id = spec.run_id or make_run_id(cfg)

    def prepare(df: DataFrame) -> DataFrame:
        if spec.dedup:
            df = filter_rows(df, spec.predicate) if spec.predicate is not None else df
            df = first_arrivals(df, spec.dedup_keys, spec.horizon)
        df = transform(df, replace(spec, dedup=False, predicate=None if spec.dedup else spec.predicate))
        return stamp_lineage(df, cfg, run_id=run_id) if spec.lineage else df

    df = prepare(stream)
    bound = {
        WRITER_PROPERTY: STREAM_WRITER,
        CHECKPOINT_PROPERTY: checkpoint,
        SOURCE_PROPERTY: f"{spec.input_path} {spec.input_glob or ''}".strip(),
    }
    tables = [(target, df.schema, spec.location)]
    by_batch = spec.expected is not None
    if by_batch:
        number = StructField(BATCH_COLUMN, LongType())
        if taken := {BATCH_COLUMN, REASONS} & {c.lower() for c in (*df.columns, *stream.columns)}:
            raise ConfigError(f"invalid config: {sorted(taken)} are the quarantine's own columns")
        misfits(stream, spec.expected)  # a missing column is found before anything starts
        beside = TableName(target.catalog, target.database, spec.quarantine)
        place = f"{spec.location.rstrip('/')}_{spec.quarantine}" if spec.location else None
        kept = StructType([*stream.schema.fields, StructField(REASONS, ArrayType(StringType())), number])
        tables = [(target, StructType([*df.schema.fields, number]), spec.location), (beside, kept, place)]
    for name, columns, location in tables:
        create_table_if_absent(spark, name, columns, spec.table_format, location, bound, (BATCH_COLUMN,) if by_batch else ())
        has = table_properties(spark, name)
        if has.get(WRITER_PROPERTY) != STREAM_WRITER:
            # The stream's sink log would hide the rows already in the table.
            raise ValueError(f"{name} was not created by the incremental job; append to it in batch")
        for key, value in bound.items():
            if has.get(key) != value:
                raise ValueError(f"{name} is bound to {key} = {has.get(key)!r}, not {value!r}: rows of another stream would be lost")
    if by_batch:
        append_batches(stream, spec, prepare, target, tables[1][0], checkpoint).awaitTermination()
    else:
        append_stream(df, target, checkpoint).awaitTermination()
    return spark.table(target.quoted)
