"""Check a table against the schema its config expects.

One row per expected column: the expected and actual types, whether they
match, and how many non-null values could not be converted to the expected
type at all (``try_cast`` gives NULL). The counts come from one pass with a
partial aggregate per task; nothing but one small row reaches the final merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    ByteType,
    DataType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
)

from tablewright.names import quote_ident
from tablewright.typing_rules import same_type, widens

# Characters Spark's integral and decimal parsers can accept: any Unicode
# decimal digit, sign, point (and an exponent for decimals), plus the
# whitespace and ISO control characters they trim. A string with any other character can
# never convert, so it is counted without calling the parser, whose failure
# path is far slower than a regex test.
_INTEGRAL_CHARS = r"^[\x00-\x20\x7F-\x9F+\-.\p{Nd}]*$"
_DECIMAL_CHARS = r"^[\x00-\x20\x7F-\x9F+\-.eE\p{Nd}]*$"
# Floating point also takes inf/infinity/nan and Java's own syntax (hex
# digits with an x and a p exponent, d/f suffixes); booleans take
# t/true/y/yes/1 and f/false/n/no/0, each case-insensitive.
_FLOATING_CHARS = r"^[\x00-\x20\x7F-\x9F+\-.\p{Nd}a-fA-FiInNpPtTxXyY]*$"
_BOOLEAN_CHARS = r"^[\x00-\x20\x7F-\x9F01tTrRuUeEyYsSfFaAlLnNoO]*$"


def _normalise(type_text: str) -> DataType:
    return DataType.fromDDL(type_text)


def _unconvertible(col: Column, have: DataType, want: DataType) -> Column:
    """True where a non-null value has no ``want`` representation."""
    failed = col.try_cast(want).isNull()
    if isinstance(have, StringType):
        if isinstance(want, (ByteType, ShortType, IntegerType, LongType)):
            return F.when(~col.rlike(_INTEGRAL_CHARS), F.lit(True)).otherwise(failed)
        if isinstance(want, DecimalType):
            return F.when(~col.rlike(_DECIMAL_CHARS), F.lit(True)).otherwise(failed)
        if isinstance(want, (DoubleType, FloatType)):
            return F.when(~col.rlike(_FLOATING_CHARS), F.lit(True)).otherwise(failed)
        if isinstance(want, BooleanType):
            return F.when(~col.rlike(_BOOLEAN_CHARS), F.lit(True)).otherwise(failed)
    return failed


def _castable(df: DataFrame, col: Column, want: DataType) -> bool:
    try:
        return bool(df.select(col.try_cast(want)).columns)
    except AnalysisException:
        return False


def misfits(df: DataFrame, expected: Sequence[tuple[str, str]]) -> Column:
    """Per row, the names of the expected columns that hold a value with no representation in their
    type, as an array. A column that is missing altogether is the whole frame's fault: ``ValueError``."""
    found = {f.name.lower(): f for f in df.schema.fields}
    if missing := [name for name, _ in expected if name.lower() not in found]:
        raise ValueError(f"missing expected columns {missing}")
    wrong = []
    for name, type_text in expected:
        field, want = found[name.lower()], _normalise(type_text)
        if widens(field.dataType, want):
            continue
        col = F.col(quote_ident(field.name))
        bad = _unconvertible(col, field.dataType, want) if _castable(df, col, want) else F.lit(True)
        wrong.append(F.when(col.isNotNull() & bad, F.lit(name)))
    if not wrong:
        return F.array().cast("array<string>")
    return F.filter(F.array(*wrong), lambda x: x.isNotNull())


def schema_check(df: DataFrame, expected: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows ``(name, expected, actual, ok, bad_rows)``, one per ``(column, type)``
    in ``expected``; ``actual`` and ``bad_rows`` are NULL for a missing column.

    Names resolve by the session's case rule; types are equal if they differ in
    nullability only. Columns whose type is equal or widens safely are not read; of a
    type that cannot be cast at all, every non-null value is a bad row.
    """
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive", "false").lower() == "true"
    fold = (lambda n: n) if exact else str.lower
    found = {fold(f.name): f for f in df.schema.fields}
    checks = []
    counts = []
    for i, (name, type_text) in enumerate(expected):
        want = _normalise(type_text)
        field = found.get(fold(name))
        have = field.dataType if field else None
        bad_rows = F.lit(None if field is None else 0).cast("bigint")
        if field is not None and not widens(have, want):
            col = F.col(quote_ident(field.name))
            bad = _unconvertible(col, have, want) if _castable(df, col, want) else F.lit(True)
            total = F.sum(F.when(col.isNotNull() & bad, F.lit(1)).otherwise(F.lit(0)))
            counts.append(F.coalesce(total, F.lit(0)).cast("bigint").alias(f"b{i}"))
            bad_rows = F.col(f"b{i}")
        checks.append(
            F.struct(
                F.lit(name).alias("name"),
                F.lit(want.simpleString()).alias("expected"),
                F.lit(have.simpleString() if have is not None else None).cast("string").alias("actual"),
                F.lit(have is not None and same_type(have, want)).alias("ok"),
                bad_rows.alias("bad_rows"),
            )
        )
    # With nothing to count there is nothing to scan.
    base = df.agg(*counts) if counts else df.sparkSession.range(1)
    return base.select(F.inline(F.array(*checks)))
