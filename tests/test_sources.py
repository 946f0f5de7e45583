"""Sources: the driver's tables, file reads with a given schema, the range generator."""

import pytest

from conftest import SF_SMALL
from tablewright.sources import TABLES, load_table, range_source, read_files


def test_every_driver_table_loads(spark):
    for name in TABLES:
        assert load_table(spark, SF_SMALL, name).columns


def test_unknown_table_is_refused(spark):
    with pytest.raises(ValueError):
        load_table(spark, SF_SMALL, "lineitems")


def test_trailing_slash_in_folder(spark):
    assert load_table(spark, SF_SMALL + "/", "region").count() == 5


def test_read_with_given_schema_prunes_and_types(spark):
    df = read_files(spark, f"{SF_SMALL}/orders.parquet", schema="o_orderkey bigint, o_orderstatus string")
    assert df.columns == ["o_orderkey", "o_orderstatus"]
    assert df.count() == 1500


def test_range_source_is_distributed(spark):
    df = range_source(spark, 0, 10_000, num_partitions=7)
    assert df.rdd.getNumPartitions() == 7
    assert df.agg({"id": "sum"}).collect()[0][0] == sum(range(10_000))
