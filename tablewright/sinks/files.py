"""File sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablewright.operators.partitions import rebalance, sized


def write_files(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] | None = None,
    **options: str,
) -> str:
    """Write ``df`` to ``path``; by default an existing path is an error. Returns the path."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_sized(df: DataFrame, path: str, max_bytes: int, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), **options: str) -> str:
    """``write_files`` in files of ``max_bytes`` at most and few small ones; see ``rebalance`` and ``sized``."""
    with sized(df.sparkSession, max_bytes):
        return write_files(rebalance(df, max_bytes, partition_by), path, fmt, mode, partition_by, **options)
