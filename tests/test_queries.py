"""Each registered query of the reference's operators against its SQL, on the smallest tables."""

import pytest

from ledgerloom.plans import REGISTRIES
from tests.oracle import check, connect

QUERIES = {k: v for r in REGISTRIES for k, v in r.queries.items()}
SQL = {k: v for r in REGISTRIES for k, v in r.sql.items()}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        check(df, con, SQL[name])
    else:
        assert df.count() > 0


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["item_id", "doc_id", "score", "rank"]
