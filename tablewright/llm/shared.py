"""Intermediate tables in the cluster's shared folder, and packed exchange of arrays."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tablewright.session import fresh_path


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written under ``spark.checkpoint.dir`` and read back: its lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def discard(*kept: DataFrame) -> None:
    """Delete tables that ``keep`` wrote and no later result reads."""
    for df in kept:
        jvm = getattr(df.sparkSession, "_jvm", None)
        if jvm is None:  # without a JVM at hand they stay for the folder's owner
            return
        path = jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give back the memory that a task has freed. Spark's Python workers go on to other tasks, and what the
    allocators hold back adds to what these need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a task over batches, that starts without what the worker's last task left and gives back
    its own memory when the last batch and the arrays made of it are gone, too."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from run(batches)
        release()

    return task


def packed(bucket: np.ndarray, n_buckets: int, *columns: np.ndarray) -> list[tuple[int, tuple[bytes, ...]]]:
    """The entries of each bucket as bytes, a row per bucket that has any; entries keep their order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    sorted_columns = [c[order] for c in columns]
    return [(b, tuple(c[x:y].tobytes() for c in sorted_columns)) for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]


def unpacked(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype)
