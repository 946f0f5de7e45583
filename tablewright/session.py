"""Session helpers: a local session for tests and benches, and the shared folder.

Jobs never pick a machine-local folder on a cluster: anything they write
outside a catalog goes under the folder the cluster names in
``spark.checkpoint.dir``. Only a local session with no such setting gets a
fresh temporary one.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tablewright") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Unset on a local master (tests), a fresh temporary folder is created and
    registered as the checkpoint dir; unset on a cluster is an error.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    missing = f"{CHECKPOINT_CONF} is not set; jobs need a shared folder on a cluster"
    try:
        sc = spark.sparkContext
    except Exception as exc:  # Spark Connect sessions have no SparkContext
        raise RuntimeError(missing) from exc
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(missing)
    folder = tempfile.mkdtemp(prefix="tablewright-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, unused location under the shared folder."""
    return f"{shared_dir(spark)}/{label}/{uuid.uuid4().hex}"


def fresh_table_suffix() -> str:
    return uuid.uuid4().hex[:16]
