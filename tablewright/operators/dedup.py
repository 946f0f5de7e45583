"""Optional deduplication: whole rows, or one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablewright.operators.pick import pick_per_key


def deduplicate(
    df: DataFrame,
    keys: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Without keys, drop repeated whole rows; with keys, keep the first row
    per key in ``order_by`` order (ascending, ties broken by the other columns).
    Both are hash-partitioned aggregates with a map-side combine."""
    if not keys:
        return df.dropDuplicates()
    return pick_per_key(df, keys, order_by or [], smallest=True)
