"""Manifest of a data set: what is in it, how big, and a content fingerprint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.hashing import fingerprint
from tablewright.names import quote_ident

# Wide enough that summing 35-bit values cannot overflow (about 3e27 rows).
FINGERPRINT_TYPE = "decimal(38,0)"


def manifest(df: DataFrame, group_by: Sequence[str], content: str) -> DataFrame:
    """Per group: ``row_count``, ``size_bytes`` (UTF-8 bytes of ``content``) and
    ``fingerprint`` (sum of the eight 32-bit words of each row's SHA-256).

    All three are sums, so each task pre-aggregates and the shuffle carries
    one small row per group and task; the fingerprint does not depend on row
    order or partitioning. Empty groups never appear; NULL content adds no
    bytes and no fingerprint.
    """
    text = F.col(quote_ident(content))
    return df.groupBy(*[F.col(quote_ident(g)) for g in group_by]).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint").alias("size_bytes"),
        F.coalesce(
            F.sum(fingerprint(text).cast(FINGERPRINT_TYPE)),
            F.lit(0).cast(FINGERPRINT_TYPE),
        ).alias("fingerprint"),
    )


def stamp_manifest(df: DataFrame, run_id: str) -> DataFrame:
    """Prefix a manifest with its run id, ready to append to a manifest table."""
    return df.select(F.lit(run_id).alias("run_id"), *df.columns)
