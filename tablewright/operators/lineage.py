"""Run lineage stamped on each output row."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.config import config_sha256


def stamp_lineage(df: DataFrame, cfg: Mapping[str, Any], **extra: str) -> DataFrame:
    """Add ``config_sha256`` (and any ``extra`` literal columns).

    The values are literals in the plan, so they travel to the executors
    with the tasks; no broadcast variable is needed.
    """
    columns = {"config_sha256": F.lit(config_sha256(cfg))}
    columns.update({k: F.lit(v) for k, v in extra.items()})
    return df.withColumns(columns)
