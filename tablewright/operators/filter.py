"""Predicate filter and a count that stays a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_rows(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.filter(predicate)


def count_rows(df: DataFrame, alias: str = "n") -> DataFrame:
    """One-row frame with the count: partial counts per task, one tiny final merge."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def filter_count(df: DataFrame, predicate: Column | str, alias: str = "n") -> DataFrame:
    return count_rows(filter_rows(df, predicate), alias)
