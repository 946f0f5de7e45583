"""The latest row per key, kept current in a bucketed table.

A run's rows are first reduced to one per key, then joined to the state. The state is
bucketed and sorted by the key, so only the run's rows are shuffled, into the state's buckets;
history is read, merged and written bucket by bucket. Each update writes a new version of the
state; a view names the current one and is replaced once the version is whole, so readers see
one version or the next, and an update that was cut off is written anew. The version
before the current one stays for readers that still use it.

Defined results: ties on the order are broken by the other columns, as in ``latest_per_key``; null keys
are a key; applying a run twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.hashing import row_text
from tablewright.names import TableName, quote_ident
from tablewright.operators.latest import latest_per_key
from tablewright.operators.pick import _orderable
from tablewright.sinks.tables import table_properties

KEY = "tw_key"
VERSION_PROPERTY = "tablewright.version"


def _version(name: TableName, version: int) -> TableName:
    return TableName(name.catalog, name.database, f"{name.table}_v{version:06d}")


def current_version(spark: SparkSession, name: TableName) -> int:
    """The state's version; 0 before the first update."""
    if not spark.catalog.tableExists(name.quoted):
        return 0
    version = table_properties(spark, name).get(VERSION_PROPERTY)
    if version is None:
        raise ValueError(f"{name} exists and is no latest-row state")
    return int(version)


def merged(state: DataFrame, news: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The later row of ``state`` and ``news``, each with one row per ``KEY``."""
    columns = [c for c in news.columns if c != KEY]
    rest = [c for c in columns if c not in order_by and _orderable(news.schema[c].dataType)]
    s, n = state.alias("tw_state"), news.alias("tw_news")

    def order(side: str):
        return F.struct(*[F.col(f"{side}.{quote_ident(c)}") for c in (*order_by, *rest)])

    takes = F.col(f"tw_state.{KEY}").isNull() | (F.col(f"tw_news.{KEY}").isNotNull() & (order("tw_news") > order("tw_state")))
    chosen = [F.when(takes, F.col(f"tw_news.{quote_ident(c)}")).otherwise(F.col(f"tw_state.{quote_ident(c)}")).alias(c) for c in columns]
    return s.join(n, KEY, "full_outer").select(F.col(KEY), *chosen)


def update_latest(spark: SparkSession, name: TableName, rows: DataFrame, keys: Sequence[str], order_by: Sequence[str], buckets: int = 64) -> DataFrame:
    """Bring the state ``name`` (a view) up to date with a run's rows; returns it."""
    if KEY in rows.columns:
        raise ValueError(f"{KEY} is the state's own column")
    news = latest_per_key(rows, keys, order_by)
    news = news.withColumn(KEY, row_text(*keys))
    version = current_version(spark, name)
    if version:
        state = spark.table(_version(name, version).quoted)
        if set(state.columns) != set(news.columns):
            raise ValueError(f"columns do not match {name}: {sorted(set(state.columns) ^ set(news.columns))}")
        found = merged(state, news.select(*state.columns), order_by)
    else:
        found = news.repartition(buckets, KEY)
    target = _version(name, version + 1)
    found.write.mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY).format("parquet").saveAsTable(target.quoted)
    shown = ", ".join(quote_ident(c) for c in rows.columns)
    spark.sql(f"CREATE OR REPLACE VIEW {name.quoted} TBLPROPERTIES ('{VERSION_PROPERTY}' = '{version + 1}') AS SELECT {shown} FROM {target.quoted}")
    if version > 1:
        spark.sql(f"DROP TABLE IF EXISTS {_version(name, version - 1).quoted}")
    return spark.table(name.quoted)
