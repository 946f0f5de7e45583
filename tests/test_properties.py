"""Property tests: one-row-per-key and manifests against brute force on
random frames with NULL keys, NULL orderings and many ties."""

import hashlib
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tablewright.operators import deduplicate, latest_per_key, manifest

SCHEMA = "k string, o long, v string"
KEYS = st.sampled_from(["a", "b", "c", "", "long " * 30, None])
ORDERS = st.one_of(st.none(), st.integers(min_value=-3, max_value=3))
VALUES = st.sampled_from(["x", "y", "z", "é", None])
ROWS = st.lists(st.tuples(KEYS, ORDERS, VALUES), max_size=40)
SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.too_slow])


def _sort_key(row, positions):
    # Spark's ascending struct order: NULL first, then values.
    return tuple((row[i] is not None, row[i] if row[i] is not None else 0) for i in positions)


def brute_pick(rows, largest):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    pick = max if largest else min
    return sorted((pick(g, key=lambda r: _sort_key(r, (1, 2))) for g in groups.values()), key=repr)


@SETTINGS
@given(rows=ROWS)
def test_dedup_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in deduplicate(df, ["k"], ["o"]).collect()), key=repr)
    assert got == brute_pick(rows, largest=False)


@SETTINGS
@given(rows=ROWS)
def test_latest_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in latest_per_key(df, ["k"], ["o"]).collect()), key=repr)
    assert got == brute_pick(rows, largest=True)


@SETTINGS
@given(rows=ROWS)
def test_manifest_matches_brute_force(spark, rows):
    want = defaultdict(lambda: [0, 0, 0])
    for k, _, v in rows:
        slot = want[v]
        slot[0] += 1
        if k is not None:
            slot[1] += len(k.encode("utf-8"))
            digest = hashlib.sha256(k.encode("utf-8")).hexdigest()
            slot[2] += sum(int(digest[i : i + 8], 16) for i in range(0, 64, 8))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.v: [r.row_count, r.size_bytes, int(r.fingerprint)] for r in manifest(df, ["v"], "k").collect()}
    assert got == dict(want)


# Characters around the edges of Spark's number parsers: ASCII and other
# Unicode digits, signs, points, exponents, whitespace and control
# characters, letters that spell special values.
NUMBERISH = st.text(
    alphabet=st.sampled_from(
        list("0123456789+-.eE dDfFlLnNaIiytTrRuUsSoOpPxXbc_,\t\n\r\x00\x0b\x1f\x7f\x85\xa0") + ["١", "３", "　"]
    ),
    max_size=12,
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(values=st.lists(NUMBERISH, min_size=1, max_size=60))
def test_schema_screen_never_changes_try_cast(spark, values):
    from pyspark.sql import functions as F
    from pyspark.sql.types import DataType, StringType

    from tablewright.operators.schema import _unconvertible

    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    for want in ("tinyint", "int", "bigint", "decimal(10,3)", "decimal(38,0)", "double", "float", "boolean"):
        target = DataType.fromDDL(want)
        rows = df.select(
            "i",
            _unconvertible(F.col("s"), StringType(), target).alias("screened"),
            F.col("s").try_cast(target).isNull().alias("direct"),
        ).collect()
        mismatched = [(values[r.i], want) for r in rows if r.screened != r.direct]
        assert not mismatched, mismatched


COMPOSITE = st.lists(
    st.tuples(
        st.sampled_from(["a", "b", None]),
        st.integers(min_value=0, max_value=2),
        ORDERS,
        st.one_of(st.none(), st.sampled_from([1.5, -0.5, 2.0])),
        VALUES,
    ),
    max_size=40,
)


@SETTINGS
@given(rows=COMPOSITE, largest=st.booleans())
def test_pick_with_composite_keys_and_orders(spark, rows, largest):
    from tablewright.operators import pick_per_key

    df = spark.createDataFrame(rows, "k1 string, k2 int, o1 long, o2 double, v string")
    got = sorted((tuple(r) for r in pick_per_key(df, ["k1", "k2"], ["o1", "o2"], smallest=not largest).collect()), key=repr)
    groups = defaultdict(list)
    for r in rows:
        groups[(r[0], r[1])].append(r)
    pick = max if largest else min
    want = sorted((pick(g, key=lambda r: _sort_key(r, (2, 3, 4))) for g in groups.values()), key=repr)
    assert got == want
