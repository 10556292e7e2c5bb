"""Every registered query against its SQL twin on whole tables."""

import pytest
from oracle_check import compare, connect

from rolelens.catalog.oracle import ORACLE
from rolelens.catalog.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLE[name]) > 0
