"""Which types are the same, and which hold every value of another."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    ByteType,
    DataType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    MapType,
    NullType,
    ShortType,
    StringType,
    StructType,
)

_INTEGERS = (ByteType, ShortType, IntegerType, LongType)
#: Decimal digits that hold every value of an integer type.
_DIGITS = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 19}


def same_type(a: DataType, b: DataType) -> bool:
    """Equal but for nullability."""
    return widens(a, b) and widens(b, a)


def widens(have: DataType, want: DataType) -> bool:
    """Whether every value of ``have`` is a value of ``want``, unchanged."""
    if have == want or isinstance(have, NullType):
        return True
    if isinstance(have, StringType) and isinstance(want, StringType):
        return True
    if isinstance(have, ArrayType) and isinstance(want, ArrayType):
        return widens(have.elementType, want.elementType)
    if isinstance(have, MapType) and isinstance(want, MapType):
        return widens(have.keyType, want.keyType) and widens(have.valueType, want.valueType)
    if isinstance(have, StructType) and isinstance(want, StructType):
        names = [f.name.lower() for f in have.fields] == [f.name.lower() for f in want.fields]
        return names and all(widens(a.dataType, b.dataType) for a, b in zip(have.fields, want.fields))
    if isinstance(want, DecimalType):
        if isinstance(have, DecimalType):
            return want.scale >= have.scale and want.precision - want.scale >= have.precision - have.scale
        return type(have) in _DIGITS and want.precision - want.scale >= _DIGITS[type(have)]
    if isinstance(want, DoubleType):
        return isinstance(have, (FloatType, ByteType, ShortType, IntegerType))
    if isinstance(have, _INTEGERS) and isinstance(want, _INTEGERS):
        return _INTEGERS.index(type(have)) <= _INTEGERS.index(type(want))
    return False
