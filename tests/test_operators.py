"""Operators against brute force on small hand-made frames (skew, ties, NULLs)."""

import datetime as dt
import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tablewright.operators import (
    cap_partitions,
    count_rows,
    deduplicate,
    derive,
    double_id,
    filter_count,
    latest_per_key,
    manifest,
    schema_check,
    stamp_lineage,
)
from tablewright.config import config_sha256
from tablewright.sources import range_source

SCHEMA = StructType(
    [
        StructField("id", LongType(), True),
        StructField("k", StringType(), True),
        StructField("ts", LongType(), True),
        StructField("payload", StringType(), True),
    ]
)


def skewed_rows(n=3000, seed=7):
    """A third of all rows share one key; some keys/orderings are NULL; ties exist."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            k = "hot " * 50  # one long hot key
        elif i % 97 == 0:
            k = None
        else:
            k = f"key{rnd.randrange(200)}"
        ts = None if i % 131 == 0 else rnd.randrange(50)
        rows.append((i, k, ts, f"p{rnd.randrange(5)}"))
    return rows


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.createDataFrame(skewed_rows(), SCHEMA).repartition(6)


# ---- range source and derived column (the original job's frame) -----------------------

def test_range_double_matches_brute_force(spark):
    df = double_id(range_source(spark, 0, 1000))
    assert df.columns == ["id", "double"]
    rows = sorted((r.id, r.double) for r in df.collect())
    assert rows == [(i, 2 * i) for i in range(1000)]
    assert [f.nullable for f in df.schema.fields] == [False, False]


def test_range_partitions_and_step(spark):
    df = range_source(spark, 5, 50, 5, num_partitions=3)
    assert sorted(r.id for r in df.collect()) == list(range(5, 50, 5))


def test_derive_replaces_same_name_and_keeps_rows(spark):
    df = range_source(spark, 0, 10)
    out = derive(df, {"id": "id + 100", "sq": F.col("id") * F.col("id")})
    assert out.count() == 10
    assert out.columns == ["id", "sq"]
    assert sorted(r.id for r in out.collect()) == list(range(100, 110))


def test_derive_empty_mapping_is_identity(spark):
    df = range_source(spark, 0, 3)
    assert derive(df, {}) is df


def test_double_overflow_raises_under_ansi(spark):
    df = double_id(spark.createDataFrame([(2**62,)], "id bigint"))
    with pytest.raises(Exception):
        df.collect()


# ---- filter + count ----------------------------------------------------------------------

def test_filter_even_count_is_500(spark):
    out = filter_count(range_source(spark, 0, 1000), "id % 2 = 0")
    assert out.columns == ["n"]
    assert out.collect()[0].n == 500


def test_count_of_empty_is_zero(spark):
    assert count_rows(range_source(spark, 0, 0)).collect()[0].n == 0


# ---- partition cap ------------------------------------------------------------------------

def test_cap_never_raises_count(spark):
    one = range_source(spark, 0, 100, num_partitions=1)
    assert cap_partitions(one, 200).rdd.getNumPartitions() == 1
    many = range_source(spark, 0, 100, num_partitions=16)
    assert cap_partitions(many, 4).rdd.getNumPartitions() == 4
    assert cap_partitions(many, None).rdd.getNumPartitions() == 16


def test_cap_keeps_rows(spark):
    capped = cap_partitions(range_source(spark, 0, 1000, num_partitions=16), 3)
    assert capped.rdd.getNumPartitions() == 3
    assert sorted(r.id for r in capped.collect()) == list(range(1000))


def test_cap_rejects_zero(spark):
    with pytest.raises(ValueError):
        cap_partitions(range_source(spark, 0, 3), 0)


# ---- deduplication ------------------------------------------------------------------------

def _first_per_key(rows, key_idx, order_idx, largest=False):
    """Brute force: per key, the row that is smallest (largest) by
    (order columns, then the other non-key columns), Nones first."""
    groups = defaultdict(list)
    for r in rows:
        groups[tuple(r[i] for i in key_idx)].append(r)
    rest = [i for i in range(len(rows[0])) if i not in key_idx]
    ordering = list(dict.fromkeys(list(order_idx) + rest))

    def sort_key(r):
        return tuple((r[i] is not None, r[i] if r[i] is not None else 0) for i in ordering)

    pick = max if largest else min
    return sorted((pick(g, key=sort_key) for g in groups.values()), key=repr)


def test_dedup_by_key_matches_brute_force(spark, skewed):
    rows = skewed_rows()
    got = sorted((tuple(r) for r in deduplicate(skewed, ["k"], ["id"]).collect()), key=repr)
    assert got == _first_per_key(rows, [1], [0])


def test_dedup_by_key_with_ties_is_deterministic(spark, skewed):
    rows = skewed_rows()
    out = deduplicate(skewed, ["k"], ["ts"])  # many ties on ts
    a = sorted((tuple(r) for r in out.collect()), key=repr)
    b = sorted((tuple(r) for r in deduplicate(skewed.repartition(3), ["k"], ["ts"]).collect()), key=repr)
    assert a == b == _first_per_key(rows, [1], [2])


def test_dedup_whole_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, None), (None, None)], "x int, y string")
    assert sorted(map(tuple, deduplicate(df).collect()), key=repr) == sorted(
        [(1, "a"), (2, "b"), (None, None)], key=repr
    )


def test_dedup_keeps_column_order(spark, skewed):
    assert deduplicate(skewed, ["k"], ["id"]).columns == skewed.columns


def test_dedup_unknown_column(spark, skewed):
    with pytest.raises(ValueError):
        deduplicate(skewed, ["nope"], ["id"])


# ---- latest per key -----------------------------------------------------------------------

def test_latest_per_key_matches_brute_force(spark, skewed):
    rows = skewed_rows()
    got = sorted((tuple(r) for r in latest_per_key(skewed, ["k"], ["ts", "id"]).collect()), key=repr)
    assert got == _first_per_key(rows, [1], [2, 0], largest=True)


def test_latest_per_key_with_timestamps(spark):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(1, t0, "a"), (1, t0 + dt.timedelta(seconds=1), "b"), (2, t0, "c"), (2, t0, "d")]
    df = spark.createDataFrame(rows, "user long, ts timestamp_ntz, v string")
    got = {r.user: r.v for r in latest_per_key(df, ["user"], ["ts"]).collect()}
    assert got == {1: "b", 2: "d"}  # tie on ts broken by the remaining column, largest wins


# ---- manifest -------------------------------------------------------------------------------

def test_manifest_matches_hashlib(spark, skewed):
    rows = skewed_rows()
    want = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        g = want[r[3]]
        g[0] += 1
        text = r[1]
        if text is not None:
            g[1] += len(text.encode("utf-8"))
            digest = hashlib.sha256(text.encode("utf-8")).hexdigest()
            g[2] += sum(int(digest[i : i + 8], 16) for i in range(0, 64, 8))
    got = {r.payload: [r.row_count, r.size_bytes, int(r.fingerprint)] for r in manifest(skewed, ["payload"], "k").collect()}
    assert got == {k: v for k, v in want.items()}


def test_manifest_fingerprint_ignores_order_and_partitioning(spark, skewed):
    a = {tuple(r) for r in manifest(skewed, ["payload"], "k").collect()}
    b = {tuple(r) for r in manifest(skewed.orderBy(F.desc("id")).coalesce(1), ["payload"], "k").collect()}
    assert a == b


def test_manifest_multibyte_sizes(spark):
    df = spark.createDataFrame([("g", "héllo"), ("g", "日本")], "g string, t string")
    r = manifest(df, ["g"], "t").collect()[0]
    assert r.size_bytes == len("héllo".encode()) + len("日本".encode())


# ---- schema check ---------------------------------------------------------------------------

def test_schema_check(spark):
    df = spark.createDataFrame(
        [(1, "10", 2.5), (2, "x", None), (None, None, 1e20)], "a bigint, b string, c double"
    )
    out = schema_check(df, [("a", "bigint"), ("b", "int"), ("c", "decimal(10,2)"), ("d", "string"), ("a", "integer")])
    got = [tuple(r) for r in out.collect()]
    assert got == [
        ("a", "bigint", "bigint", True, 0),
        ("b", "int", "string", False, 1),
        ("c", "decimal(10,2)", "double", False, 1),
        ("d", "string", None, False, None),
        ("a", "int", "bigint", False, 0),
    ]


def test_schema_check_all_missing(spark):
    df = range_source(spark, 0, 5)
    assert [tuple(r) for r in schema_check(df, [("zz", "int")]).collect()] == [("zz", "int", None, False, None)]


# ---- lineage --------------------------------------------------------------------------------

def test_stamp_lineage_literals(spark):
    cfg = {"a": 1}
    out = stamp_lineage(range_source(spark, 0, 3), cfg, run_id="r1")
    assert {(r.config_sha256, r.run_id) for r in out.collect()} == {(config_sha256(cfg), "r1")}


TRICKY = [
    "1", " 2 ", "+3", "-4", "5.0", "5.5", "1e3", "1E-2", "abc", "1-URGENT", "", " ", "\t7\n",
    "9999999999", "-9223372036854775808", "9223372036854775808", "١٢", "１２", " 8", "\u00858",
    "0x10", "--1", "1.", ".5", "+", "Infinity", "NaN", "1_000", "12 34", "　8",
    "inf", "-INF", "+infinity", "nan", "0x1p3", "0x1.8P1", "1d", "2F", "1e", "e5", "yes", " No ", "t",
    "TRUE", "tru", "y", "0", "1", "off", "1.5e308", "1e400", "-0.0",
]


@pytest.mark.parametrize(
    "want",
    ["tinyint", "smallint", "int", "bigint", "decimal(12,2)", "decimal(38,0)", "double", "float", "boolean", "date"],
)
def test_schema_check_screen_is_exact(spark, want):
    """The regex pre-screen never changes a result: compare with plain try_cast row by row."""
    from pyspark.sql.types import DataType

    from tablewright.operators.schema import _unconvertible

    df = spark.createDataFrame(list(enumerate(TRICKY)), "i int, s string")
    target = DataType.fromDDL(want)
    rows = df.select(
        "i",
        _unconvertible(F.col("s"), StringType(), target).alias("screened"),
        F.col("s").try_cast(target).isNull().alias("direct"),
    ).collect()
    assert [(r.i, r.screened) for r in rows] == [(r.i, r.direct) for r in rows]
    expected_bad = sum(r.direct for r in rows)
    assert schema_check(df, [("s", want)]).collect()[0].bad_rows == expected_bad


def test_manifest_of_empty_input(spark):
    empty = spark.createDataFrame([], "g string, t string")
    assert manifest(empty, ["g"], "t").count() == 0
    whole = manifest(empty, [], "t").collect()[0]
    assert (whole.row_count, whole.size_bytes, int(whole.fingerprint)) == (0, 0, 0)


def test_dotted_column_names(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 9), (3, "b", 1)], "`i.d` long, `k.ey` string, `t.s` long")
    assert sorted(tuple(r) for r in deduplicate(df, ["k.ey"], ["i.d"]).collect()) == [(1, "a", 5), (3, "b", 1)]
    assert sorted(tuple(r) for r in latest_per_key(df, ["k.ey"], ["t.s"]).collect()) == [(2, "a", 9), (3, "b", 1)]
    m = {r["k.ey"]: r.row_count for r in manifest(df, ["k.ey"], "k.ey").collect()}
    assert m == {"a": 2, "b": 1}


def test_sql_literal_is_one_int_row(spark):
    """D-2's documented example: SQL text gives a one-row table of type int."""
    df = spark.sql("SELECT 1 + 1 AS result")
    assert df.dtypes == [("result", "int")]
    assert [tuple(r) for r in df.collect()] == [(2,)]


def test_preview_shows_the_first_rows(spark, capsys):
    """D-3: ``show`` is built in; it prints a bounded preview."""
    range_source(spark, 0, 1000).show(5)
    printed = capsys.readouterr().out
    assert "only showing top 5 rows" in printed and "|  4|" in printed


def test_derive_name_resolution(spark):
    """Spark's lateral column aliases: a later expression may use an earlier
    new column; a name that exists in the input means the input column."""
    df = range_source(spark, 0, 3)
    out = derive(df, {"id": "id + 10", "copy": "id"})  # "copy" sees the input id
    assert sorted((r.id, r.copy) for r in out.collect()) == [(10, 0), (11, 1), (12, 2)]
    lateral = derive(df, {"a": "id + 1", "b": "a * 2"})
    assert sorted((r.a, r.b) for r in lateral.collect()) == [(1, 2), (2, 4), (3, 6)]
    with pytest.raises(Exception):
        derive(df, {"b": "a * 2", "a": "id + 1"}).collect()  # used before it is defined


def test_whole_row_sha256(spark):
    """R-1 for whole rows: SHA-256 of the row's JSON text."""
    import json

    from tablewright.functions import row_sha256

    df = spark.createDataFrame([(1, "a", None), (1, "a", 2.5), (2, "a", None)], "x long, y string, z double")
    hashes = [r.h for r in df.select(row_sha256("x", "y", "z").alias("h")).collect()]
    assert len(set(hashes)) == 3  # any column's value changes the hash, NULL included
    again = [r.h for r in df.repartition(3).orderBy("x", "z").select(row_sha256("x", "y", "z").alias("h")).collect()]
    assert sorted(again) == sorted(hashes)  # a function of the row only
    text = json.dumps({"x": 1, "y": "a", "z": None}, separators=(",", ":"))
    assert hashes[0] == hashlib.sha256(text.encode()).hexdigest()
    assert [r.h for r in df.select(row_sha256().alias("h")).collect()] == hashes  # no names: every column
    dotted = df.withColumnRenamed("x", "a.b")
    assert dotted.select(row_sha256("a.b").alias("h")).distinct().count() == 2


def test_row_sha256_does_not_depend_on_the_time_zone(spark):
    from tablewright.functions import row_sha256

    before = spark.conf.get("spark.sql.session.timeZone")
    df = spark.sql("SELECT timestamp_seconds(1700000000) AS t, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS n")
    try:
        digests = set()
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            digests.add(df.select(row_sha256().alias("h")).first().h)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert len(digests) == 1


def test_keys_that_differ_only_by_collation_are_one(spark):
    from tablewright.operators import deduplicate, latest_per_key

    df = spark.createDataFrame([(1, "A", {"x": 1}), (2, "a", {"x": 2}), (3, "b", {"x": 3})], "id long, k string, m map<string,int>")
    collated = df.withColumn("k", F.col("k").cast("string collate UTF8_LCASE"))
    assert sorted((r.id, r.k, r.m["x"]) for r in deduplicate(collated, ["k"], ["id"]).collect()) == [(1, "A", 1), (3, "b", 3)]
    assert sorted((r.id, r.k, r.m["x"]) for r in latest_per_key(collated, ["k"], ["id"]).collect()) == [(2, "a", 2), (3, "b", 3)]
    assert deduplicate(collated.select("k"), ["k"]).count() == 2


def test_map_columns_travel_with_their_row(spark):
    from tablewright.operators import deduplicate

    df = spark.createDataFrame([(2, "k", {"x": 2}), (1, "k", {"x": 1})], "id long, k string, m map<string,int>")
    assert [(r.id, r.m) for r in deduplicate(df, ["k"], ["id"]).collect()] == [(1, {"x": 1})]
    with pytest.raises(ValueError, match="without an order"):
        deduplicate(df, ["k"], ["m"])


def test_schema_check_reports_what_it_cannot_cast(spark):
    df = spark.createDataFrame([(1, [1]), (2, [2]), (None, None)], "id long, xs array<int>")
    strict = df.select("id", F.coalesce("xs", F.array(F.lit(0))).alias("xs"))
    got = [tuple(r)[2:] for r in schema_check(df, [("id", "date"), ("id", "array<int>"), ("ID", "bigint"), ("xs", "array<int>")]).collect()]
    assert got == [("bigint", False, 2), ("bigint", False, 2), ("bigint", True, 0), ("array<int>", True, 0)]
    assert schema_check(strict, [("xs", "array<int>")]).first().ok


def test_schema_check_reads_only_what_it_must(spark, tmp_path):
    import contextlib
    import io

    spark.createDataFrame([(1, "t", 2)], "a long, b string, c int").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")

    def plan(out):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            out.explain("formatted")
        return buf.getvalue()

    assert "ReadSchema: struct<a:bigint>" in plan(schema_check(df, [("a", "int"), ("b", "string"), ("c", "bigint")]))
    assert "parquet" not in plan(schema_check(df, [("a", "bigint"), ("b", "string"), ("c", "bigint")]))
