"""Table addressing: ``catalog.database.table``, and where a job finds them.

One quoted form serves both the SQL side (``IDENTIFIER(:t)``) and the
DataFrame side (``spark.table``, ``writeTo``), so the two can never drift.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

# Session confs a job reads its target catalog and database from.
CATALOG_CONF = "spark.tablewright.catalog"
DATABASE_CONF = "spark.tablewright.database"
SESSION_CATALOG = "spark_catalog"

# Letters, digits and underscores only: the session catalog rejects dashes
# in database names, and the unquoted DataFrame form cannot even parse them.
_PART = re.compile(r"^[A-Za-z0-9_]+$")


def quote_ident(name: str) -> str:
    """Backtick-quote one identifier (a column or field name), doubling backticks."""
    return "`" + name.replace("`", "``") + "`"


def is_name(value: object) -> bool:
    return isinstance(value, str) and bool(_PART.match(value))


def check_part(kind: str, value: str) -> str:
    if not is_name(value):
        raise ValueError(f"invalid {kind} name {value!r}: use letters, digits and underscores")
    return value


@dataclass(frozen=True)
class TableName:
    catalog: str
    database: str
    table: str

    def __post_init__(self) -> None:
        check_part("catalog", self.catalog)
        check_part("database", self.database)
        check_part("table", self.table)

    @property
    def parts(self) -> tuple[str, str, str]:
        return (self.catalog, self.database, self.table)

    @property
    def quoted(self) -> str:
        """Every part backtick-quoted; valid for SQL and DataFrame APIs alike."""
        return ".".join(f"`{p}`" for p in self.parts)

    @property
    def dotted(self) -> str:
        return ".".join(self.parts)

    @property
    def in_session_catalog(self) -> bool:
        return self.catalog == SESSION_CATALOG

    @classmethod
    def parse(cls, text: str) -> "TableName":
        parts = [p.strip("`") for p in text.split(".")]
        if len(parts) != 3:
            raise ValueError(f"expected catalog.database.table, got {text!r}")
        return cls(*parts)

    def __str__(self) -> str:
        return self.dotted


def resolve_table(spark: SparkSession, table: str, catalog: str | None = None, database: str | None = None) -> TableName:
    """The job's target: each part as the job gives it, else from the session's
    confs; the catalog is the session's own if neither names one."""
    said = {"catalog": catalog or spark.conf.get(CATALOG_CONF, "") or SESSION_CATALOG, "database": database or spark.conf.get(DATABASE_CONF, "")}
    if not said["database"]:
        raise RuntimeError(f"no target database: set {DATABASE_CONF} or table.database")
    return TableName(**said, table=table)
