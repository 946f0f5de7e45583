"""Append of rows whose columns differ from the table's: by name at every depth.

Columns and nested fields that the rows lack are filled with null, narrower types are widened,
order does not matter, and columns that the table lacks are added to it. What a table
cannot take unchanged is refused before anything is altered or written: a type that it cannot hold,
a nested field that it does not have (a file table's nested types are fixed), two names that differ in case only.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NullType, StructField, StructType

from tablewright.names import TableName, quote_ident
from tablewright.sinks.tables import append, column_ddl
from tablewright.typing_rules import widens

_ALTERING = threading.Lock()


def _by_name(schema: StructType, at: str) -> dict[str, StructField]:
    found = {f.name.lower(): f for f in schema.fields}
    if len(found) < len(schema.fields):
        raise ValueError(f"names in {at or 'the rows'} differ in case only")
    return found


def fitted(column: Column, have: DataType, want: DataType, at: str) -> Column:
    """``column`` of type ``have`` as one of type ``want``, every value unchanged; ``at`` names it in errors."""
    if have == want:
        return column
    if isinstance(have, StructType) and isinstance(want, StructType):
        rebuilt = F.struct(*_fields(lambda name: column.getField(name), have, want, at))
        return F.when(column.isNotNull(), rebuilt)
    if isinstance(have, ArrayType) and isinstance(want, ArrayType):
        return F.transform(column, lambda x: fitted(x, have.elementType, want.elementType, f"{at}[]"))
    if isinstance(have, MapType) and isinstance(want, MapType):
        # different keys stay different: widening and filling keep apart what was
        keyed = column if have.keyType == want.keyType else F.transform_keys(column, lambda k, _: fitted(k, have.keyType, want.keyType, f"{at} key"))
        return F.transform_values(keyed, lambda _, v: fitted(v, have.valueType, want.valueType, f"{at} value"))
    if not widens(have, want):
        raise ValueError(f"{at}: {have.simpleString()} does not fit {want.simpleString()}")
    return column.cast(want)


def _fields(get, have: StructType, want: StructType, at: str) -> list[Column]:
    """The fields of ``want`` in its order, from ``get(name)`` where ``have`` has them, else null."""
    own, target = _by_name(have, at), _by_name(want, at)
    unknown = [own[n].name for n in own if n not in target]
    if unknown:
        raise ValueError(f"{at or 'the table'} has no place for {unknown}")
    out = []
    for n, f in target.items():
        full = f"{at}.{f.name}" if at else f.name
        value = fitted(get(own[n].name), own[n].dataType, f.dataType, full) if n in own else F.lit(None).cast(f.dataType)
        out.append(value.alias(f.name))
    return out


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the columns and types of ``schema``, matched by name at every depth."""
    return df.select(*_fields(lambda name: F.col(quote_ident(name)), df.schema, schema, ""))


def added_columns(have: StructType, table: StructType) -> list[StructField]:
    """The columns of ``have`` that the table lacks."""
    known = _by_name(table, "the table")
    new = [f for n, f in _by_name(have, "").items() if n not in known]
    untyped = [f.name for f in new if isinstance(f.dataType, NullType)]
    if untyped:
        raise ValueError(f"new columns without a type: {untyped}")
    return [StructField(f.name, f.dataType, True) for f in new]


def append_evolving(df: DataFrame, name: TableName) -> list[str]:
    """Append ``df`` to the table ``name``, adding the columns it lacks; returns their names.

    Adding is metadata only, and earlier rows read null. It is a commit of its own: if the
    append after it fails, the table has the columns and no new rows. Like ``append``, not idempotent.
    """
    spark = df.sparkSession
    with _ALTERING:
        table = spark.table(name.quoted).schema
        new = added_columns(df.schema, table)
        rows = conform(df, StructType([*table.fields, *new]))  # raises before anything is altered
        if new:
            spark.sql(f"ALTER TABLE IDENTIFIER(:t) ADD COLUMNS ({column_ddl(StructType(new))})", args={"t": name.quoted})
    append(rows, name)
    return [f.name for f in new]
