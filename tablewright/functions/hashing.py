"""Content hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from tablewright.names import quote_ident


def _col(c: Column | str) -> Column:
    return F.col(quote_ident(c)) if isinstance(c, str) else c


def sha256_hex(c: Column | str) -> Column:
    """Lower-case hex SHA-256 of a string (UTF-8 bytes) or binary column."""
    return F.sha2(_col(c), 256)


# Every digit that a timestamp holds, and the zone of those that name an instant.
_JSON = {
    "timeZone": "UTC",
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _has_map(t: DataType) -> bool:
    if isinstance(t, StructType):
        return any(_has_map(f.dataType) for f in t.fields)
    return isinstance(t, MapType) or isinstance(t, ArrayType) and _has_map(t.elementType)


def _in_order(c: Column, t: DataType) -> Column:
    """``c`` with its maps as lists of entries sorted by key; equal maps give equal lists."""
    if not _has_map(t):
        return c
    if isinstance(t, ArrayType):
        return F.transform(c, lambda x: _in_order(x, t.elementType))
    if isinstance(t, StructType):
        return F.when(c.isNotNull(), F.struct(*[_in_order(c.getField(f.name), f.dataType).alias(f.name) for f in t.fields]))
    entry = lambda e: F.struct(e["key"].alias("key"), _in_order(e["value"], t.valueType).alias("value"))
    return F.array_sort(F.transform(F.map_entries(c), entry))


def row_text(*cols: Column | str, of: DataFrame | None = None) -> Column:
    """A row (the given columns, or all) as JSON text: nulls shown, timestamps to the microsecond,
    instants in UTC whatever the session's time zone. With ``of``, the frame whose rows are
    meant, maps are written in the order of their keys."""
    if of is not None and not cols:
        return F.to_json(F.struct(*[_in_order(_col(f.name), f.dataType).alias(f.name) for f in of.schema.fields]), _JSON)
    row = F.struct(*[_col(c) for c in cols]) if cols else F.struct("*")
    return F.to_json(row, _JSON)


def row_sha256(*cols: Column | str, of: DataFrame | None = None) -> Column:
    """SHA-256 of a whole row, or of the given columns, through its JSON text."""
    return F.sha2(row_text(*cols, of=of), 256)


def digest_sum(digest: Column) -> Column:
    """The eight 32-bit words of a hex SHA-256, added up, as a non-negative bigint.

    Its sum over a group is an order-insensitive fingerprint that a
    partial aggregate can combine map-side; every bit of the digest counts.
    """
    words = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(8)]
    total = words[0]
    for w in words[1:]:
        total = total + w
    return total


def fingerprint(c: Column | str) -> Column:
    return digest_sum(sha256_hex(c))
