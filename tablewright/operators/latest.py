"""Latest row per key from an append-only table: last writer wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablewright.operators.pick import pick_per_key


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Row with the largest ``order_by`` per key; list a unique column last in
    ``order_by`` (e.g. ``["ts", "event_id"]``) to make the tie-break explicit."""
    return pick_per_key(df, keys, order_by, smallest=False)
