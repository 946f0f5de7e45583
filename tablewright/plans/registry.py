"""Named queries over the driver's tables, each with a DuckDB oracle.

Every query reads whole tables (``orders``, ``documents``, ``events``) so
its work grows with them. Queries that write use a fresh table or folder
under the shared folder per call, since appends are not idempotent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.config import make_run_id
from tablewright.functions import row_sha256 as whole_row_sha256
from tablewright.functions import sha256_hex
from tablewright.names import DATABASE_CONF, SESSION_CATALOG, TableName
from tablewright.operators import (
    cap_partitions,
    compare,
    deduplicate,
    derive,
    double_id,
    estimates,
    filter_count,
    latest_per_key,
    manifest,
    manifest_sketches,
    merge_sketches,
    schema_check,
    stamp_lineage,
    stamp_manifest,
    write_digested,
)
from tablewright.plans.job import run
from tablewright.session import fresh_path, fresh_table_suffix
from tablewright.sinks import (
    append,
    append_evolving,
    compact_ledger,
    create_table_if_absent,
    publish_run,
    read_latest_run,
    read_runs,
    run_ledger,
    unpublished_runs,
    update_latest,
    write_files,
    write_run,
    write_sized,
)
from tablewright.sources import load_table, read_files
from tablewright.streaming import run_incremental

Query = Callable[[SparkSession, str], DataFrame]


def _fresh_table(spark: SparkSession, label: str) -> tuple[TableName, str]:
    return (
        TableName(SESSION_CATALOG, "default", f"tw_{label}_{fresh_table_suffix()}"),
        fresh_path(spark, f"tables/{label}"),
    )


# --- I-2 derived column, on a whole table --------------------------------------------

def derive_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(load_table(spark, sf_dir, "orders"), {"double": "o_orderkey * 2"})


# --- D-1 filter by SQL predicate, then count -------------------------------------------

def filter_even_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documented example predicate, counted over the whole table."""
    return filter_count(load_table(spark, sf_dir, "orders"), "o_orderkey % 2 = 0")


def filter_count_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison predicate: Catalyst pushes it into the Parquet scan."""
    return filter_count(load_table(spark, sf_dir, "orders"), "o_orderstatus = 'F' AND o_totalprice > 100000")


# --- D-2 SQL text, D-8 parameters as plan literals --------------------------------------

def sql_text_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT o_orderkey AS id, o_orderkey * :factor AS `double` FROM {orders}",
        args={"factor": 2},
        orders=load_table(spark, sf_dir, "orders"),
    )


# --- I-5 create if absent, I-6 append by name --------------------------------------------

def _orders_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = load_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return double_id(ids)


def append_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders_ids(spark, sf_dir)
    name, location = _fresh_table(spark, "append")
    create_table_if_absent(spark, name, df.schema, "parquet", location)
    append(df, name)
    return spark.table(name.quoted)


def append_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders_ids(spark, sf_dir)
    name, location = _fresh_table(spark, "append2")
    for _ in range(2):
        create_table_if_absent(spark, name, df.schema, "parquet", location)
        append(df.select("double", "id"), name)  # by name: the order does not matter
    return spark.table(name.quoted)


def append_evolved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended in three shapes to a table with structs, arrays and maps: whole; with fields missing, narrower and
    in another order; with a column that the table does not have. Read back flat."""
    orders = load_table(spark, sf_dir, "orders")
    key, status, price, priority = (F.col(c) for c in ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))
    part = F.pmod(key, F.lit(3))
    whole = orders.filter(part == 0).select(
        key.alias("id"),
        F.struct(status.alias("status"), price.alias("price")).alias("info"),
        F.array(F.struct(key.alias("n"), priority.alias("label"))).alias("tags"),
        F.create_map(status, F.struct(key.alias("n"), priority.alias("label"))).alias("by_status"),
    )
    narrow = orders.filter(part == 1).select(
        F.create_map(status, F.struct(key.cast("int").alias("N"))).alias("by_status"),
        F.array(F.struct(priority.alias("label"), (key % 100).cast("tinyint").alias("n"))).alias("TAGS"),
        F.struct(status.alias("status")).alias("info"),
        key.cast("int").alias("id"),
    )
    grown = orders.filter(part == 2).select(key.alias("id"), F.struct(price.alias("price"), status.alias("status")).alias("info"), priority.alias("priority"))
    name, location = _fresh_table(spark, "evolved")
    create_table_if_absent(spark, name, whole.schema, "parquet", location)
    for rows in (whole, narrow, grown):
        append_evolving(rows, name)
    tag, of = F.col("tags")[0], F.col("by_status")[F.col("info.status")]
    return spark.table(name.quoted).select(
        "id", "info.status", "info.price", tag["n"].alias("tag_n"), tag["label"].alias("tag_label"), of["n"].alias("map_n"), of["label"].alias("map_label"), "priority"
    )


# --- D-4 read input_path, write output_path -----------------------------------------------

def copy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = write_files(load_table(spark, sf_dir, "orders"), fresh_path(spark, "copies/orders"))
    return read_files(spark, out)


# --- D-5 partition cap ---------------------------------------------------------------------------

MAX_FILES = 3


def capped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written in at most MAX_FILES files: their rows, and whether the cap held."""
    out = write_files(cap_partitions(load_table(spark, sf_dir, "orders"), MAX_FILES), fresh_path(spark, "copies/capped"))
    per_file = read_files(spark, out).groupBy("_metadata.file_path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), (F.count(F.lit(1)) <= MAX_FILES).alias("within_cap"))


MAX_FILE_BYTES = 8 << 20


def sized_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in folders by status, in files of MAX_FILE_BYTES at most: the rows of each, and whether the bound held."""
    out = write_sized(load_table(spark, sf_dir, "orders"), fresh_path(spark, "copies/sized"), MAX_FILE_BYTES, partition_by=["o_orderstatus"])
    sizes = F.max("_metadata.file_size") <= MAX_FILE_BYTES
    return read_files(spark, out).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), sizes.alias("within_bound"))


# --- D-6 deduplication -----------------------------------------------------------------------

def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(load_table(spark, sf_dir, "documents"), keys=["text"], order_by=["doc_id"])


# --- D-7 schema check against config -----------------------------------------------------------

# Fixed expectations for the orders check: one exact match, a narrower
# integer, a decimal, a string column expected as int, and a missing column.
ORDERS_EXPECTED = [
    ("o_orderkey", "bigint"),
    ("o_custkey", "int"),
    ("o_totalprice", "decimal(12,2)"),
    ("o_orderpriority", "int"),
    ("o_comment", "string"),
]


def schema_check_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_check(load_table(spark, sf_dir, "orders"), ORDERS_EXPECTED)


DOCUMENTS_EXPECTED = [("doc_id", "bigint"), ("TEXT", "string"), ("n_chars", "int"), ("lang", "date")]


def schema_check_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal types are not read; a name in other case resolves; no language is a date."""
    return schema_check(load_table(spark, sf_dir, "documents"), DOCUMENTS_EXPECTED)


# --- R-1 content fingerprint per row -------------------------------------------------------

def row_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    return docs.select("doc_id", sha256_hex("text").alias("sha256"))


def row_sha256_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each whole row of orders."""
    return load_table(spark, sf_dir, "orders").select("o_orderkey", whole_row_sha256().alias("sha256"))


def row_sha256_micros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of events' rows whose times have microseconds."""
    events = load_table(spark, sf_dir, "events")
    moved = events.select("event_id", F.timestamp_add("MICROSECOND", F.col("event_id") % 1000000, F.col("ts")).alias("ts"))
    return moved.select("event_id", whole_row_sha256(of=moved).alias("sha256"))


# --- R-2 manifest per group ----------------------------------------------------------------

def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(load_table(spark, sf_dir, "documents"), ["source"], "text")


# The manifest appended per run to one manifest table (two runs).
MANIFEST_RUNS = ("20260101_000000", "20260102_000000")


def manifest_run_id(created_at: str) -> str:
    return make_run_id({"manifest": "documents", "run": created_at}, created_at)


def manifest_table_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    name, location = _fresh_table(spark, "manifests")
    for created_at in MANIFEST_RUNS:
        rows = stamp_manifest(manifest(docs, ["source"], "text"), manifest_run_id(created_at))
        create_table_if_absent(spark, name, rows.schema, "parquet", location)
        append(rows, name)
    return spark.table(name.quoted)


def manifest_sketches_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of two runs of orders, stored, then merged without their rows; beside the exact values, whether
    the estimates are within their bounds (three standard errors; a rank off by 2.5 % at most)."""
    orders = load_table(spark, sf_dir, "orders")
    path = fresh_path(spark, "sketches/orders")
    for i, half in enumerate(("o_custkey % 2 = 0", "o_custkey % 2 <> 0")):
        write_files(manifest_sketches(orders.filter(half), ["o_orderstatus"], "o_custkey", "o_totalprice"), f"{path}/run_id={i}")
    merged = estimates(merge_sketches(read_files(spark, path), ["o_orderstatus"]), (0.1, 0.5, 0.9))
    ranked = orders.join(F.broadcast(merged), "o_orderstatus").groupBy("o_orderstatus")  # a row per status
    checked = ranked.agg(
        F.first("row_count").alias("row_count"),
        (F.abs(F.first("distinct_count") - F.count_distinct("o_custkey")) <= 0.05 * F.count_distinct("o_custkey")).alias("distinct_ok"),
        *[F.avg((F.col("o_totalprice") <= F.col("quantiles")[i]).cast("double")).alias(f"rank{i}") for i in range(3)],
    )
    ranks_ok = F.lit(True)
    for i, q in enumerate((0.1, 0.5, 0.9)):
        ranks_ok = ranks_ok & (F.abs(F.col(f"rank{i}") - q) <= 0.025)
    return checked.select("o_orderstatus", "row_count", "distinct_ok", ranks_ok.alias("quantiles_ok"))


def compare_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of orders, compared by their digest trees: keys added, removed and changed."""
    orders = load_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kept = orders.filter(key % 997 != 0).withColumn("o_totalprice", F.when(key % 499 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    newer = kept.unionByName(orders.filter(key % 701 == 2).withColumn("o_orderkey", key + COMPARE_OFFSET))
    paths = [write_digested(df, fresh_path(spark, f"versions/{label}"), "o_orderkey", COMPARE_WIDTH) for label, df in (("old", orders), ("new", newer))]
    return compare(spark, *paths, orders.schema, "o_orderkey", COMPARE_WIDTH)


#: New orders get keys from here on; keys in a leaf.
COMPARE_OFFSET, COMPARE_WIDTH = 1_000_000_000, 256


# --- R-3 latest row per key -------------------------------------------------------------------

def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_per_key(load_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])


def latest_state_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event per user, kept in a bucketed state that three runs bring up to date."""
    events = load_table(spark, sf_dir, "events")
    name, _ = _fresh_table(spark, "latest_state")
    for i in range(3):
        update_latest(spark, name, events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i), ["user_id"], ["ts", "event_id"], buckets=8)
    return spark.table(name.quoted)


# --- R-4 write-once run folders, R-5 lineage columns ------------------------------------------

# Two runs of the same job with different start times; the configs hold no
# paths, so their hashes are the same wherever the data lives.
RUN_TIMES = ("20260101_000000", "20260102_000000")


def run_config(created_at: str) -> dict:
    return {"source": {"table": "orders"}, "run": {"created_at": created_at}}


def run_partition_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load_table(spark, sf_dir, "orders")
    root = fresh_path(spark, "runs/orders")
    stamped = None
    for created_at in RUN_TIMES:
        cfg = run_config(created_at)
        stamped = stamp_lineage(orders, cfg)
        publish_run(stamped, root, make_run_id(cfg, created_at), cfg, PUBLISHED_JOB)
    first = run_config(RUN_TIMES[0])
    return read_runs(spark, root, stamped.schema, run_id=make_run_id(first, RUN_TIMES[0]))


# Published runs: two published, then a newer one written but never
# published (a driver lost before the ledger row); readers must skip it.
PUBLISHED_JOB = "orders_copy"
PUBLISHED_TIMES = ("20260101_000000", "20260102_000000")
UNPUBLISHED_TIME = "20260103_000000"


def _publish_orders_runs(spark: SparkSession, sf_dir: str):
    orders = load_table(spark, sf_dir, "orders")
    root = fresh_path(spark, "runs/published")
    stamped = None
    for created_at in PUBLISHED_TIMES:
        cfg = run_config(created_at)
        stamped = stamp_lineage(orders, cfg)
        publish_run(stamped, root, make_run_id(cfg, created_at), cfg, PUBLISHED_JOB)
    cfg = run_config(UNPUBLISHED_TIME)
    write_run(stamp_lineage(orders, cfg), root, make_run_id(cfg, UNPUBLISHED_TIME))
    return root, stamped.schema


def run_ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = _publish_orders_runs(spark, sf_dir)
    # Location, publishing time and versions depend on where it runs; the rest is exact.
    return run_ledger(spark, root).select("job", "run_id", "created_at", "config_sha256", "row_count", "size_bytes", "fingerprint")


def latest_run_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, schema = _publish_orders_runs(spark, sf_dir)
    return read_latest_run(spark, root, schema, PUBLISHED_JOB)


def compacted_ledger_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of two runs, compacted, then a third run published, and one never: what the ledger says of each run, the
    folder that it does not name, and the latest run as read back."""
    root, schema = _publish_orders_runs(spark, sf_dir)
    compact_ledger(spark, root)
    orders = load_table(spark, sf_dir, "orders")
    publish_run(orders.filter("o_orderstatus = 'F'"), root, AFTER_RUN, {}, PUBLISHED_JOB)
    ledger = run_ledger(spark, root).select("run_id", F.lit("entry").alias("kind"), "row_count")
    lost = unpublished_runs(spark, root).select("run_id", F.lit("unpublished").alias("kind"), F.lit(None).cast("long").alias("row_count"))
    last = read_latest_run(spark, root, orders.schema, PUBLISHED_JOB).groupBy("run_id").agg(F.lit("latest").alias("kind"), F.count(F.lit(1)).alias("row_count"))
    return ledger.unionByName(lost).unionByName(last)


AFTER_RUN = "20260104_000000-0000000c"


# --- I-7 the composed job, end to end ------------------------------------------------------------

def documents_job_config(spark: SparkSession, sf_dir: str) -> dict:
    name, location = _fresh_table(spark, "documents")
    return {
        "table": {
            "name": name.table,
            "catalog": name.catalog,
            "database": name.database,
            "format": "parquet",
            "location": location,
        },
        "source": {"path": f"{sf_dir.rstrip('/')}/documents.parquet"},
        "processing": {
            "enable_deduplication": True,
            "dedup_keys": ["text"],
            "dedup_order": ["doc_id"],
            "derive": {
                "n_bytes": "CAST(octet_length(text) AS BIGINT)",
                "sha256": "sha2(text, 256)",
            },
        },
        "schema": {"expected": [["doc_id", "bigint"], ["text", "string"]]},
    }


def job_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, documents_job_config(spark, sf_dir))


def job_orders_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target's database from the session (I-4), rows stamped with the config's hash and the
    run's id, and the run in the ledger: the table's rows beside what the ledger says of them."""
    name, location = _fresh_table(spark, "recorded")
    root = fresh_path(spark, "runs/recorded")
    cfg = {
        "table": {"name": name.table, "location": location},
        "source": {"path": f"{sf_dir.rstrip('/')}/orders.parquet"},
        "processing": {"filter": "o_orderstatus = 'F'"},
        "schema": {"expected": [["o_orderkey", "bigint"]]},
        "run": {"lineage": True, "root": root, "id": RECORDED_RUN, "job": "recorded"},
    }
    before = spark.conf.get(DATABASE_CONF, None)
    spark.conf.set(DATABASE_CONF, name.database)
    try:
        rows = run(spark, cfg)
    finally:
        spark.conf.unset(DATABASE_CONF) if before is None else spark.conf.set(DATABASE_CONF, before)
    ledger = run_ledger(spark, root).select("run_id", F.col("row_count").alias("ledger_rows"))
    return rows.drop("config_sha256").join(F.broadcast(ledger), "run_id")  # one ledger row


RECORDED_RUN = "20260105_000000-5eed5eed"


def job_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job run twice into one table, with lineage: the rows of the run that its ledger calls the latest."""
    name, location = _fresh_table(spark, "latest")
    root = fresh_path(spark, "runs/latest")
    cfg = {
        "table": {"name": name.table, "catalog": name.catalog, "database": name.database, "location": location},
        "source": {"path": f"{sf_dir.rstrip('/')}/orders.parquet"},
        "run": {"lineage": True, "root": root, "job": "nightly", "environment": "test"},
    }
    for run_id, predicate in zip(LATEST_RUNS, ("o_orderstatus = 'F'", "o_totalprice > 100000")):
        run(spark, {**cfg, "processing": {"filter": predicate}, "run": {**cfg["run"], "id": run_id, "note": predicate}})
    return read_latest_run(spark, root, load_table(spark, sf_dir, "orders").schema, "nightly")


LATEST_RUNS = ("20260106_000000-0000000a", "20260107_000000-0000000b")


def job_to_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job with an output path instead of a table."""
    return run(spark, {"source": {"path": f"{sf_dir.rstrip('/')}/orders.parquet"}, "output": {"path": fresh_path(spark, "copies/job")}, "processing": {"derive": {"double": "o_orderkey * 2"}}})


# --- I-6/I-7 incrementally: the same job as a checkpointed file stream ---------------------------

def stream_append_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Started twice on the same checkpoint, the job still stores each order once."""
    name, location = _fresh_table(spark, "stream")
    cfg = {
        "table": {"name": name.table, "catalog": name.catalog, "database": name.database, "location": location},
        # the table may be one file or a folder of files
        "source": {"path": f"{sf_dir.rstrip('/')}/orders.parquet*"},
        "processing": {"derive": {"double": "o_orderkey * 2"}},
        "streaming": {"checkpoint": fresh_path(spark, "streams/orders")},
    }
    run_incremental(spark, cfg)
    return run_incremental(spark, cfg)


def stream_dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts arriving in two parts, the job started anew for the second: each text is stored once."""
    docs = load_table(spark, sf_dir, "documents")
    name, location = _fresh_table(spark, "stream_dedup")
    source = fresh_path(spark, "inputs/documents")
    cfg = {
        "table": {"name": name.table, "catalog": name.catalog, "database": name.database, "location": location},
        "source": {"path": f"{source}/*", "schema": docs.schema},
        "processing": {"enable_deduplication": True, "dedup_keys": ["text"]},
        "streaming": {"checkpoint": fresh_path(spark, "streams/documents"), "horizon": "30 days"},
    }
    for i in range(2):
        write_files(docs.filter(F.pmod(F.col("doc_id"), F.lit(2)) == i), f"{source}/part{i}")
        run_incremental(spark, cfg)
    return spark.table(name.quoted).select(F.sha2("text", 256).alias("sha256"))


QUARANTINED_TYPE = "decimal(7,2)"


def stream_quarantine_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders checked as they arrive: those whose price does not fit go to a table of their own."""
    name, location = _fresh_table(spark, "checked")
    aside = f"{name.table}_aside"
    cfg = {
        "table": {"name": name.table, "catalog": name.catalog, "database": name.database, "location": location},
        "source": {"path": f"{sf_dir.rstrip('/')}/orders.parquet*"},
        "schema": {"expected": [["o_orderkey", "bigint"], ["o_totalprice", QUARANTINED_TYPE]], "quarantine": aside},
        "streaming": {"checkpoint": fresh_path(spark, "streams/checked")},
    }
    run_incremental(spark, cfg)
    good = run_incremental(spark, cfg).select("o_orderkey", "o_totalprice", F.lit("").alias("misfits"))
    bad = spark.table(TableName(name.catalog, name.database, aside).quoted)
    return good.unionByName(bad.select("o_orderkey", "o_totalprice", F.array_join("misfits", ",").alias("misfits")))


QUERIES: dict[str, Query] = {
    "derive_orders": derive_orders,
    "filter_even_orders": filter_even_orders,
    "filter_count_orders": filter_count_orders,
    "sql_text_orders": sql_text_orders,
    "append_roundtrip": append_roundtrip,
    "append_twice": append_twice,
    "append_evolved_orders": append_evolved_orders,
    "copy_orders": copy_orders,
    "capped_orders": capped_orders,
    "sized_orders": sized_orders,
    "dedup_documents": dedup_documents,
    "schema_check_orders": schema_check_orders,
    "schema_check_documents": schema_check_documents,
    "row_sha256": row_sha256,
    "row_sha256_whole": row_sha256_whole,
    "row_sha256_micros": row_sha256_micros,
    "manifest_documents": manifest_documents,
    "manifest_table_documents": manifest_table_documents,
    "manifest_sketches_orders": manifest_sketches_orders,
    "compare_orders": compare_orders,
    "latest_per_key": latest_events,
    "latest_state_events": latest_state_events,
    "run_partition_roundtrip": run_partition_roundtrip,
    "run_ledger_orders": run_ledger_orders,
    "latest_run_orders": latest_run_orders,
    "compacted_ledger_orders": compacted_ledger_orders,
    "job_documents": job_documents,
    "job_orders_recorded": job_orders_recorded,
    "job_latest_run": job_latest_run,
    "job_to_path": job_to_path,
    "stream_append_orders": stream_append_orders,
    "stream_dedup_documents": stream_dedup_documents,
    "stream_quarantine_orders": stream_quarantine_orders,
}


# --- oracles -------------------------------------------------------------------------------------

_DEDUP_DOCUMENTS = (
    "SELECT doc_id, text, lang, source, n_chars FROM documents "
    "QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"
)

_ORDERS_IDS = 'SELECT o_orderkey AS id, o_orderkey * 2 AS "double" FROM orders'

# DuckDB type names spelled as Spark's.
_SPARK_TYPE = (
    "CASE {t} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
    "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower({t}) END"
)
_DUCK_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "decimal(12,2)": "DECIMAL(12,2)", "string": "VARCHAR"}


def _schema_check_sql() -> str:
    present = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]
    measures = []
    for i, col in enumerate(present):
        duck = _DUCK_TYPE[ORDERS_EXPECTED[i][1]]
        measures.append(
            f"count(*) FILTER (WHERE {col} IS NOT NULL AND TRY_CAST({col} AS {duck}) IS NULL) AS b{i}"
        )
        measures.append(f"any_value(typeof({col})) AS t{i}")
    rows = []
    for i, (col, want) in enumerate(ORDERS_EXPECTED):
        if col in present:
            actual = _SPARK_TYPE.format(t=f"t{i}")
            rows.append(
                f"SELECT '{col}' AS name, '{want}' AS expected, {actual} AS actual, "
                f"({actual}) = '{want}' AS ok, b{i} AS bad_rows FROM a"
            )
        else:
            rows.append(
                f"SELECT '{col}' AS name, '{want}' AS expected, CAST(NULL AS VARCHAR) AS actual, "
                "false AS ok, CAST(NULL AS BIGINT) AS bad_rows"
            )
    return f"WITH a AS (SELECT {', '.join(measures)} FROM orders) " + " UNION ALL ".join(rows)


# Fixed values, computed once outside this package: the SHA-256 of each run config's JSON text
# ({"run":{"created_at":"..."},"source":{"table":"orders"}}), and the run ids that follow.
RUN_DIGESTS = {
    "20260101_000000": "0ee93b5f1a223fc797dbada76f89edafe76a995678065b9078418367121616ba",
    "20260102_000000": "4bdb73cf90d7c552980cdf270a1f7e28764fcc87105268189c9010a5a3a4e003",
}
RUN_IDS = {"20260101_000000": "20260101_000000-0ee93b5f", "20260102_000000": "20260102_000000-4bdb73cf"}
MANIFEST_IDS = ("20260101_000000-79b0ee86", "20260102_000000-7780995f")


def _run_sql(created_at: str) -> str:
    return f"SELECT *, '{RUN_DIGESTS[created_at]}' AS config_sha256, '{RUN_IDS[created_at]}' AS run_id FROM orders"


_ORDERS_JSON = (
    "'{\"o_orderkey\":' || o_orderkey || ',\"o_custkey\":' || o_custkey || ',\"o_orderstatus\":\"' || o_orderstatus || "
    "'\",\"o_totalprice\":' || o_totalprice || ',\"o_orderdate\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || "
    "'\",\"o_orderpriority\":\"' || o_orderpriority || '\"'"
)


def _words_sql(text: str) -> str:
    """The sum of the eight 32-bit words of a text's SHA-256."""
    return "(" + " + ".join(f"('0x' || substr(sha256({text}), {8 * i + 1}, 8))::BIGINT" for i in range(8)) + ")"


def _run_ledger_sql() -> str:
    rows = []
    for created_at in PUBLISHED_TIMES:
        row = _ORDERS_JSON + f" || ',\"config_sha256\":\"{RUN_DIGESTS[created_at]}\"}}'"
        rows.append(
            f"SELECT '{PUBLISHED_JOB}' AS job, '{RUN_IDS[created_at]}' AS run_id, "
            f"'{created_at}' AS created_at, '{RUN_DIGESTS[created_at]}' AS config_sha256, "
            f"count(*) AS row_count, CAST(sum(strlen({row})) AS BIGINT) AS size_bytes, "
            f"CAST(sum(CAST({_words_sql(row)} AS DECIMAL(38,0))) AS VARCHAR) AS fingerprint FROM orders"
        )
    return " UNION ALL ".join(rows)


_MANIFEST_SQL = (
    "SELECT {run}source, count(*) AS row_count, "
    "CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS size_bytes, "
    f"CAST(coalesce(sum(CAST({_words_sql('text')} AS DECIMAL(38,0))), 0) AS DECIMAL(38,0)) "
    "AS fingerprint FROM documents GROUP BY source"
)


_LATEST_EVENTS = (
    "SELECT event_id, ts, user_id, event_type, value, props FROM events "
    "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
)


def oracles() -> dict[str, str]:
    return {
        "derive_orders": 'SELECT *, o_orderkey * 2 AS "double" FROM orders',
        "filter_even_orders": "SELECT count(*) AS n FROM orders WHERE o_orderkey % 2 = 0",
        "filter_count_orders": (
            "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000"
        ),
        "sql_text_orders": _ORDERS_IDS,
        "append_roundtrip": _ORDERS_IDS,
        "append_twice": f"{_ORDERS_IDS} UNION ALL {_ORDERS_IDS}",
        "append_evolved_orders": (
            "SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 <> 1 THEN o_totalprice END AS price, "
            "CASE o_orderkey % 3 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey % 100 END AS tag_n, "
            "CASE WHEN o_orderkey % 3 < 2 THEN o_orderpriority END AS tag_label, CASE WHEN o_orderkey % 3 < 2 THEN o_orderkey END AS map_n, "
            "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS map_label, CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS priority FROM orders"
        ),
        "sized_orders": "SELECT o_orderstatus, count(*) AS n_rows, true AS within_bound FROM orders GROUP BY o_orderstatus",
        "compacted_ledger_orders": (
            "WITH n AS (SELECT count(*) AS whole, count(*) FILTER (WHERE o_orderstatus = 'F') AS part FROM orders) "
            + " UNION ALL ".join(f"SELECT '{RUN_IDS[t]}' AS run_id, 'entry' AS kind, whole AS row_count FROM n" for t in PUBLISHED_TIMES)
            + f" UNION ALL SELECT '{AFTER_RUN}', 'entry', part FROM n UNION ALL SELECT '{AFTER_RUN}', 'latest', part FROM n WHERE part > 0"
            + f" UNION ALL SELECT '{make_run_id(run_config(UNPUBLISHED_TIME), UNPUBLISHED_TIME)}', 'unpublished', NULL FROM n"
        ),
        "copy_orders": "SELECT * FROM orders",
        "dedup_documents": _DEDUP_DOCUMENTS,
        "schema_check_orders": _schema_check_sql(),
        "capped_orders": "SELECT count(*) AS n_rows, true AS within_cap FROM orders",
        "schema_check_documents": (
            "SELECT 'doc_id' AS name, 'bigint' AS expected, 'bigint' AS actual, true AS ok, 0::BIGINT AS bad_rows "
            "UNION ALL SELECT 'TEXT', 'string', 'string', true, 0 "
            "UNION ALL SELECT 'n_chars', 'int', 'bigint', false, (SELECT count(*) FROM documents WHERE n_chars IS NOT NULL AND TRY_CAST(n_chars AS INTEGER) IS NULL) "
            "UNION ALL SELECT 'lang', 'date', 'string', false, (SELECT count(*) FROM documents WHERE lang IS NOT NULL AND TRY_CAST(lang AS DATE) IS NULL)"
        ),
        "row_sha256_whole": f"SELECT o_orderkey, sha256({_ORDERS_JSON} || '}}') AS sha256 FROM orders",
        "job_orders_recorded": (
            f"SELECT *, '{RECORDED_RUN}' AS run_id, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS ledger_rows "
            "FROM orders WHERE o_orderstatus = 'F'"
        ),
        "job_latest_run": (
            f"SELECT *, '{LATEST_RUNS[1]}' AS run_id FROM orders WHERE o_totalprice > 100000"
        ),
        "job_to_path": 'SELECT *, o_orderkey * 2 AS "double" FROM orders',
        "row_sha256_micros": (
            "SELECT event_id, sha256('{\"event_id\":' || event_id || ',\"ts\":\"' || "
            "strftime(ts + to_microseconds(event_id % 1000000), '%Y-%m-%dT%H:%M:%S.%f') || '\"}') AS sha256 FROM events"
        ),
        "row_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "manifest_documents": _MANIFEST_SQL.format(run=""),
        "manifest_table_documents": " UNION ALL ".join(
            _MANIFEST_SQL.format(run=f"'{run_id}' AS run_id, ") for run_id in MANIFEST_IDS
        ),
        "latest_per_key": _LATEST_EVENTS,
        "latest_state_events": _LATEST_EVENTS,
        "manifest_sketches_orders": (
            "SELECT o_orderstatus, count(*) AS row_count, true AS distinct_ok, true AS quantiles_ok FROM orders GROUP BY o_orderstatus"
        ),
        "compare_orders": (
            "SELECT o_orderkey, 'removed' AS change FROM orders WHERE o_orderkey % 997 = 0 "
            "UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey % 997 <> 0 AND o_orderkey % 499 = 1 "
            f"UNION ALL SELECT o_orderkey + {COMPARE_OFFSET}, 'added' FROM orders WHERE o_orderkey % 701 = 2"
        ),
        "stream_dedup_documents": "SELECT DISTINCT sha256(text) AS sha256 FROM documents",
        "stream_quarantine_orders": (
            "SELECT o_orderkey, o_totalprice, CASE WHEN TRY_CAST(o_totalprice AS DECIMAL(7,2)) IS NULL THEN 'o_totalprice' ELSE '' END AS misfits FROM orders"
        ),
        "run_partition_roundtrip": _run_sql(RUN_TIMES[0]),
        "run_ledger_orders": _run_ledger_sql(),
        "latest_run_orders": _run_sql(PUBLISHED_TIMES[-1]),
        "stream_append_orders": 'SELECT *, o_orderkey * 2 AS "double" FROM orders',
        "job_documents": (
            "SELECT doc_id, text, lang, source, n_chars, "
            "CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS sha256 "
            "FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"
        ),
    }
