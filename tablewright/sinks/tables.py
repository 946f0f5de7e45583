"""Catalog table sink.

``append`` matches columns by name and insists on the exact column set:
Spark's by-name insert would fill a missing column with NULL, and a
positional ``insertInto`` silently swaps same-typed columns. It never
creates, overwrites or merges; a missing table is an error. Appends are not
idempotent: running the same job twice stores its rows twice.
"""

from __future__ import annotations

import threading
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tablewright.names import TableName, quote_ident
from tablewright.typing_rules import widens

# Table property naming the writer that owns a table. A table written by
# the incremental job carries "stream": its folder holds the file-stream
# sink's log, and readers then ignore files the log does not list, so a
# batch append there would vanish from reads (and the other way round).
WRITER_PROPERTY = "tablewright.writer"
STREAM_WRITER = "stream"
OVERWRITE_CONF = "spark.sql.sources.partitionOverwriteMode"

# Appends to one session-catalog (file) table from concurrent jobs of one
# application share the output committer's temporary folder, and the first
# job to finish cleans it up under the others: rows vanish, sometimes with no
# error. Such appends are serialised per table within the process. Separate
# applications need a table format with its own commit protocol.
_APPEND_LOCKS: dict[str, threading.Lock] = {}
_APPEND_LOCKS_GUARD = threading.Lock()


def _append_lock(name: TableName) -> threading.Lock:
    with _APPEND_LOCKS_GUARD:
        return _APPEND_LOCKS.setdefault(name.dotted.lower(), threading.Lock())


def type_ddl(dt: DataType) -> str:
    """SQL type text with every nested field name quoted."""
    if isinstance(dt, StructType):
        return "struct<" + ",".join(f"{quote_ident(f.name)}:{type_ddl(f.dataType)}" for f in dt.fields) + ">"
    if isinstance(dt, ArrayType):
        return f"array<{type_ddl(dt.elementType)}>"
    if isinstance(dt, MapType):
        return f"map<{type_ddl(dt.keyType)},{type_ddl(dt.valueType)}>"
    return dt.simpleString()


def column_ddl(schema: StructType) -> str:
    return ", ".join(f"{quote_ident(f.name)} {type_ddl(f.dataType)}" for f in schema.fields)


def _sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_table_if_absent(
    spark: SparkSession,
    name: TableName,
    schema: StructType,
    fmt: str | None = "parquet",
    location: str | None = None,
    properties: Mapping[str, str] | None = None,
    partitioned_by: Sequence[str] = (),
) -> None:
    """``CREATE TABLE IF NOT EXISTS`` with the columns of ``schema``.

    An existing table is left as it is, even with another schema; ``append``
    then reports the mismatch. ``fmt=None`` leaves the format to the catalog
    (some v2 catalogs reject a ``USING`` clause).
    """
    text = f"CREATE TABLE IF NOT EXISTS IDENTIFIER(:t) ({column_ddl(schema)})"
    if fmt:
        if not fmt.replace("_", "").isalnum():
            raise ValueError(f"invalid table format {fmt!r}")
        text += f" USING {fmt}"
    if partitioned_by:
        text += f" PARTITIONED BY ({', '.join(map(quote_ident, partitioned_by))})"
    if location:
        text += f" LOCATION {_sql_string(location)}"
    if properties:
        pairs = ", ".join(f"{_sql_string(k)} = {_sql_string(v)}" for k, v in properties.items())
        text += f" TBLPROPERTIES ({pairs})"
    spark.sql(text, args={"t": name.quoted})


def table_properties(spark: SparkSession, name: TableName) -> dict[str, str]:
    """Catalog metadata only; no data is read."""
    rows = spark.sql("SHOW TBLPROPERTIES IDENTIFIER(:t)", args={"t": name.quoted}).collect()
    return {r["key"]: r["value"] for r in rows}


def check_fit(have: StructType, want: StructType, name: TableName) -> None:
    """Raise unless rows of ``have`` go into the table ``name`` by name, without loss."""
    own, target = ({f.name.lower(): f.dataType for f in schema.fields} for schema in (have, want))
    if set(own) != set(target):
        raise ValueError(f"columns do not match {name}: missing {sorted(set(target) - set(own))}, extra {sorted(set(own) - set(target))}")
    lossy = [f"{c}: {own[c].simpleString()} into {t.simpleString()}" for c, t in target.items() if not widens(own[c], t)]
    if lossy:
        raise ValueError(f"types do not fit {name}: {'; '.join(lossy)}")


def replace_partitions(df: DataFrame, name: TableName) -> None:
    """Write ``df`` over the partitions of the table ``name`` that it has rows of; writing the same rows
    again changes nothing. Columns are matched by name."""
    spark = df.sparkSession
    target = spark.table(name.quoted).schema
    check_fit(df.schema, target, name)
    by_lower = {c.lower(): c for c in df.columns}
    fitted = df.select(*[F.col(quote_ident(by_lower[f.name.lower()])).cast(f.dataType).alias(f.name) for f in target.fields])
    if name.in_session_catalog:
        # insertInto takes the mode from the session, not from the writer's options
        before = spark.conf.get(OVERWRITE_CONF)
        with _append_lock(name):
            spark.conf.set(OVERWRITE_CONF, "dynamic")
            try:
                fitted.write.mode("overwrite").insertInto(name.quoted)
            finally:
                spark.conf.set(OVERWRITE_CONF, before)
    else:
        fitted.writeTo(name.quoted).overwritePartitions()


def append(df: DataFrame, name: TableName) -> None:
    """Append ``df`` to the existing table ``name``, matching columns by name.

    The column sets must be equal (case-insensitive) and each type must fit the
    table's without loss. Session-catalog tables
    take ``INSERT INTO … BY NAME``; other (v2) catalogs ``writeTo().append()``.
    """
    spark = df.sparkSession
    check_fit(df.schema, spark.table(name.quoted).schema, name)  # a missing table raises here
    if table_properties(spark, name).get(WRITER_PROPERTY) == STREAM_WRITER:
        raise ValueError(f"{name} is written by the incremental job; a batch append there would not be read")
    if name.in_session_catalog:
        with _append_lock(name):
            spark.sql("INSERT INTO IDENTIFIER(:t) BY NAME SELECT * FROM {src}", args={"t": name.quoted}, src=df)
    else:
        df.writeTo(name.quoted).append()
