"""The queries that SQL expresses, against their DuckDB SQL."""

import pytest
from conftest import SF_ORACLE
from oracle import compare, duck_connection

from tablewright.llm import queries


@pytest.mark.parametrize("key", sorted(queries.oracles()))
def test_query_matches_its_sql(spark, key):
    ok, said = compare(queries.QUERIES[key](spark, SF_ORACLE), duck_connection(SF_ORACLE), queries.oracles()[key])
    assert ok, said
