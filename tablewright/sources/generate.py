"""Generated rows: ``id`` bigint, start inclusive, end exclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def range_source(
    spark: SparkSession,
    start: int = 0,
    end: int = 1000,
    step: int = 1,
    num_partitions: int | None = None,
) -> DataFrame:
    """Each task generates its own slice of ids; nothing passes through the driver."""
    return spark.range(start, end, step, num_partitions)
