"""Derived columns: add or replace columns from expressions, keep every row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derive(df: DataFrame, columns: Mapping[str, Column | str]) -> DataFrame:
    """``{name: expression}``; SQL text is parsed by Spark, a same-named column is replaced.

    One ``withColumns`` call makes one projection, so all new columns share
    the scan's codegen stage. Names resolve as in a SQL select list: a later
    expression may use an earlier new column (a lateral column alias), but a
    name that exists in the input always means the input column.
    """
    exprs = {name: F.expr(e) if isinstance(e, str) else e for name, e in columns.items()}
    return df.withColumns(exprs) if exprs else df


def double_id(df: DataFrame, source: str = "id", target: str = "double") -> DataFrame:
    """The reference job's projection: ``double = id * 2`` (bigint, ANSI overflow raises)."""
    return df.withColumn(target, F.col(source) * 2)
