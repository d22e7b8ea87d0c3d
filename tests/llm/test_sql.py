"""Queries of the corpus operators against their SQL."""

import pytest

from ledgerloom.llm import queries
from tests.oracle import check, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark, sf, con):
    check(queries.QUERIES[name](spark, sf), con, queries.ORACLE_SQL[name])


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
