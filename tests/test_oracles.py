"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as entry_module
from oracle import compare, duck_connection
from conftest import SF_ORACLE, SF_SMALL

from tablewright.plans import registry

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_ORACLE)


def test_every_query_of_the_table_jobs_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.oracles()) <= set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(registry.oracles()))
def test_query_matches_oracle(spark, con, key):
    ok, msg = compare(QUERIES[key](spark, SF_ORACLE), con, ORACLES[key])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry_module.entry(spark)
    ok, msg = compare(df, duck_connection(SF_SMALL), ORACLES["job_documents"])
    assert ok, msg
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_bytes", "sha256"]
