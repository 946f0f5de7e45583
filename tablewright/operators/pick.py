"""One row per key, chosen by an ordering, as a partial aggregate.

A ``row_number()`` window would send every row of a key to one task; with
one key holding a third of the table that task does a third of the work.
``min`` / ``max`` over a struct are aggregates instead: each map task keeps
one candidate per key before the shuffle, so a hot key costs one row per
task. The struct lists the ordering columns first and the rest after them,
so it is both the sort key and the payload: nothing is shuffled twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, CalendarIntervalType, DataType, MapType, StringType, StructType, VariantType

from tablewright.names import quote_ident

_HASH = "__tw_key_hash"
_ROW = "__tw_row"


def pick_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    smallest: bool = True,
) -> DataFrame:
    """Keep the row with the smallest (or largest) ``order_by`` per ``keys``.

    Ties on ``order_by`` are broken by the remaining columns in table order,
    so the result is deterministic; columns without an order (maps) cannot break
    ties. Nulls sort first, as in Spark's
    ascending order (so ``smallest=False`` puts them last). Output columns
    keep the input order.
    """
    keys = list(keys)
    missing = [c for c in [*keys, *order_by] if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    rest = [c for c in df.columns if c not in keys]
    # Equal keys of a collated string differ in their text: the chosen row's is shown.
    varied = [k for k in keys if _collated(df.schema[k].dataType)]
    if not rest and not varied:
        return df.dropDuplicates(keys)
    payload = [*rest, *varied]
    ordering = [c for c in dict.fromkeys([c for c in order_by if c not in keys] + payload) if _orderable(df.schema[c].dataType)]
    if unordered := [c for c in order_by if not _orderable(df.schema[c].dataType)]:
        raise ValueError(f"columns without an order: {unordered}")

    def col(name: str):
        return F.col(quote_ident(name))

    grouping = [col(k) for k in keys]
    if not varied and any(isinstance(df.schema[k].dataType, (StringType, BinaryType)) for k in keys):
        # Long string keys make the sort-based aggregate compare whole
        # texts; a leading 64-bit hash lets the sort prefix decide almost
        # every comparison, while grouping stays exact on the keys themselves.
        grouping = [F.xxhash64(*[col(k) for k in keys]).alias(_HASH), *grouping]
    if set(ordering) == set(payload):
        chosen = (F.min if smallest else F.max)(F.struct(*[col(c) for c in ordering]))
    else:
        # maps and the like have no order: they travel beside the order, not in it
        order = F.struct(*[col(c) for c in ordering]) if ordering else F.lit(0)
        chosen = (F.min_by if smallest else F.max_by)(F.struct(*[col(c) for c in payload]), order)
    picked = df.groupBy(*grouping).agg(chosen.alias(_ROW))
    row = F.col(_ROW)
    return picked.select(*[row.getField(c).alias(c) if c in payload else col(c) for c in df.columns])


def _collated(kind: DataType) -> bool:
    return isinstance(kind, StringType) and not kind.isUTF8BinaryCollation()


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType, CalendarIntervalType))
