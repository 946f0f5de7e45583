"""Helpers shared by the sink, run and streaming tests."""

from tablewright.names import TableName
from tablewright.operators import double_id
from tablewright.session import fresh_path, fresh_table_suffix
from tablewright.sources import range_source


def fresh(spark, label="t"):
    return TableName("spark_catalog", "default", f"{label}_{fresh_table_suffix()}"), fresh_path(spark, "tables")


def frame(spark, n=1000):
    return double_id(range_source(spark, 0, n))


def rows(df):
    return sorted((r.id, r.double) for r in df.collect())
