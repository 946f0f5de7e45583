"""How many partitions, and so output files, a table is written from: by number, or by bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.names import quote_ident

#: Of the bound on a file, what adaptive execution is told to aim at: it merges a last piece
#: of up to a fifth of the target into the one before, and knows block sizes to a tenth.
AIM = 0.6
#: The bound may be at least this part of what one task reads from files.
LEAST = 1024
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_SMALLEST = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
_SIZED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # else small pieces are left small, as many as there are cores
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


def cap_partitions(df: DataFrame, max_partitions: int | None) -> DataFrame:
    """Never more than ``max_partitions`` partitions, never more than before.

    ``coalesce`` merges partitions without a shuffle and never raises the count, but it
    also narrows the stage that feeds it, at any data size: a cap is for small
    outputs that must be few files. Without one, adaptive execution sizes them.
    """
    if max_partitions is None:
        return df
    if int(max_partitions) < 1:
        raise ValueError("max_partitions must be at least 1")
    return df.coalesce(int(max_partitions))


def rebalance(df: DataFrame, max_bytes: int, keys: Sequence[str] = ()) -> DataFrame:
    """``df`` behind an exchange that adaptive execution cuts and merges by bytes, so that the
    stage before stays as wide as it was. Write it inside ``sized(spark, max_bytes)``.

    What one task before the exchange sends to one place cannot be cut, so there are places enough
    for what a task reads (``spark.sql.files.maxPartitionBytes``). With ``keys`` (the folders it is written
    to) rows of a key meet, so that small keys are one file each; if a task reads more than an
    eighth of ``max_bytes``, a key's rows go to several places, by a hash of the row, and small keys are
    several files. Equal rows stay together, and a row above
    the bound is a file above it.
    """
    split = _bytes(df.sparkSession, "spark.sql.files.maxPartitionBytes", 128 << 20)
    if int(max_bytes) * LEAST < split:
        raise ValueError(f"max_bytes must be at least {-(-split // LEAST)}, a part in {LEAST} of what a task reads")
    salts = -(-8 * split // int(max_bytes))  # a task may read more: a row group is not cut, and it expands
    places = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), salts)
    if not keys:
        return df.hint("rebalance", places)
    columns = [F.col(quote_ident(k)) for k in keys]
    # types that cannot be hashed are left out of the hash
    hashed = [F.col(quote_ident(f.name)) for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    if salts == 1 or not hashed:
        return df.hint("rebalance", places, *columns)
    salt = "salt"
    while salt in {c.lower() for c in df.columns}:
        salt += "_"
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*hashed), F.lit(salts)))
    return salted.hint("rebalance", places, *columns, F.col(salt)).drop(salt)


def _bytes(spark: SparkSession, conf: str, default: int) -> int:
    """A size setting in bytes; ``default`` if it is written in a form not known here."""
    text = str(spark.conf.get(conf, str(default))).strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:], 0)
    number = text[:-1] if unit else text
    return int(number) << unit if number.isdigit() else default


@contextmanager
def sized(spark: SparkSession, max_bytes: int) -> Iterator[None]:
    """While it lasts, exchanges of this session are cut and merged towards ``max_bytes``.

    The bound is on the exchange's (compressed) bytes of a partition. A Parquet file of the same
    rows is smaller, as columns of like values compress better than rows. The
    settings are the session's: exchanges before the rebalanced one follow them too,
    as do other threads' queries that start meanwhile.
    """
    aim = f"{max(1, int(int(max_bytes) * AIM))}b"
    told = {**_SIZED, _ADVISORY: aim, _SMALLEST: aim}
    before = {name: spark.conf.get(name, None) for name in told}
    for name, value in told.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
