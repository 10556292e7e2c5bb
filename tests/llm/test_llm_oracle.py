"""The queries that SQL can express, against DuckDB on whole tables."""

import pytest
from oracle_check import compare, connect

from rolelens.llm.oracle import ORACLE
from rolelens.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert compare(spark, connect(), name, QUERIES[name], ORACLE[name]) > 0
