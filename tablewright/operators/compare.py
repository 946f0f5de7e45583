"""Two versions of a data set compared by a tree of digests over key ranges.

Data are written in blocks of key ranges, with a small table of digests beside them: a node per range of
``width`` keys (a leaf), per ``FAN`` leaves (a block), per ``FAN`` blocks and so on, up to a level of ``FAN`` nodes at most. A digest is the sum of
its rows' hash words, so a parent's is the sum of its children's and the order of rows does not matter.
A comparison starts at the top and descends only where digests differ; rows are read from the
blocks that hold differing leaves (partition pruning), and of equal ranges nothing is read again.

Defined results: rows are compared as wholes, under one integer key; a key that several rows share
is changed if the rows under it differ as a bag; a null key is a range of its own; empty data sets
have no nodes. Both sides need the same columns, width and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablewright.functions.hashing import digest_sum, row_sha256
from tablewright.names import quote_ident

#: Children of a node.
FAN = 64
#: Differing leaves that are broadcast to the scan, so that it prunes blocks; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000
BLOCK, DIGESTS = "key_block", "_digests"
# The leaf of null keys, below all others.
_NO_KEY = -(1 << 62)


def _leaf(key: Column, width: int) -> Column:
    return F.coalesce(F.floor(key.cast("bigint") / F.lit(width)).cast("bigint"), F.lit(_NO_KEY))


def _parent(node: Column) -> Column:
    return F.floor(node / F.lit(FAN)).cast("bigint")


def _sum(c: Column) -> Column:
    return F.sum(c.cast("decimal(38,0)")).cast("decimal(38,0)")


def write_digested(df: DataFrame, path: str, key: str, width: int) -> str:
    """Write ``df`` under ``path`` in blocks of ``FAN`` x ``width`` keys, and its digests under ``path/_digests``."""
    if BLOCK in df.columns:
        raise ValueError(f"{BLOCK} belongs in the path, not in the data")
    spark, block = df.sparkSession, _parent(_leaf(F.col(quote_ident(key)), width))
    # neighbouring blocks in one task, a large block in several
    dealt = df.withColumn(BLOCK, block).repartitionByRange(BLOCK, quote_ident(key))
    dealt.write.partitionBy(BLOCK).parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    hashed = rows.select(_leaf(F.col(quote_ident(key)), width).alias("node"), digest_sum(row_sha256(of=rows)).alias("digest"))
    level = hashed.groupBy("node").agg(F.count(F.lit(1)).alias("row_count"), _sum(F.col("digest")).alias("digest"))
    depth, n_nodes = 0, FAN + 1
    while n_nodes > FAN:  # negative keys meet in node -1, the others in 0
        level.withColumn("level", F.lit(depth)).write.mode("append").partitionBy("level").parquet(f"{path}/{DIGESTS}")
        own = digests(spark, path, depth)
        n_nodes = own.count()
        level = own.groupBy(_parent(F.col("node")).alias("node")).agg(F.sum("row_count").alias("row_count"), _sum(F.col("digest")).alias("digest"))
        depth += 1
    return path


def digests(spark: SparkSession, path: str, level: int) -> DataFrame:
    """``node, row_count, digest`` of a level; 0 are the leaves."""
    table = spark.read.schema("node bigint, row_count bigint, digest decimal(38,0), level int").parquet(f"{path}/{DIGESTS}")
    return table.filter(F.col("level") == level).drop("level")


def _depth(spark: SparkSession, path: str) -> int:
    """The top level; from the folders of the digests' table."""
    levels = spark.read.schema("node bigint, level int").parquet(f"{path}/{DIGESTS}").select("level").distinct()
    return max((r.level for r in levels.collect()), default=0)  # a row per level


def differing_leaves(spark: SparkSession, one: str, two: str) -> DataFrame:
    """``node`` of the leaves whose rows differ between two digested data sets."""
    nodes = None
    # a shorter tree has no nodes at the upper levels of the other: all below is looked at
    for level in range(min(_depth(spark, one), _depth(spark, two)), -1, -1):
        sides = []
        for path in (one, two):
            own = digests(spark, path, level)
            if nodes is not None:
                own = own.join(nodes.withColumnRenamed("node", "up"), _parent(F.col("node")) == F.col("up"), "left_semi")
            sides.append(own)
        left, right = sides[0], sides[1].toDF("node", "other_count", "other_digest")
        same = F.col("row_count").eqNullSafe(F.col("other_count")) & F.col("digest").eqNullSafe(F.col("other_digest"))
        nodes = left.join(right, "node", "full_outer").filter(~same).select("node")
    return nodes


def compare(spark: SparkSession, one: str, two: str, schema: StructType, key: str, width: int) -> DataFrame:
    """``key, change`` of every key whose rows differ: added, removed or changed from ``one`` to ``two``."""
    leaves = differing_leaves(spark, one, two)
    if leaves.count() <= BROADCAST_ROWS:
        leaves = F.broadcast(leaves)
    wanted = leaves.withColumn("block", _parent(F.col("node")))

    def side(path: str, count: str, digest: str) -> DataFrame:
        rows = spark.read.schema(StructType([*schema.fields, StructField(BLOCK, LongType())])).parquet(path)
        data = rows.drop(BLOCK)
        hashed = rows.select(BLOCK, F.col(quote_ident(key)).alias("key"), _leaf(F.col(quote_ident(key)), width).alias("leaf"), digest_sum(row_sha256(of=data)).alias("digest"))
        own = hashed.join(wanted, (F.col(BLOCK) == F.col("block")) & (F.col("leaf") == F.col("node")), "left_semi")
        return own.groupBy(F.col("key").alias(f"{count}_key")).agg(F.count(F.lit(1)).alias(count), _sum(F.col("digest")).alias(digest))

    before, after = side(one, "n1", "d1"), side(two, "n2", "d2")
    met = before.join(after, F.col("n1_key").eqNullSafe(F.col("n2_key")), "full_outer")
    change = F.when(F.col("n1").isNull(), "added").when(F.col("n2").isNull(), "removed").when((F.col("n1") != F.col("n2")) | (F.col("d1") != F.col("d2")), "changed")
    return met.select(F.coalesce("n1_key", "n2_key").alias(key), change.alias("change")).filter("change is not null")
