"""Filings whose numbers coincide, as they do among many suppliers, against the queries' SQL."""

import pytest

from ledgerloom.plans import filings, lateral
from tests.oracle import check, connect

#: (key, balance): header rows by value, equal numbers of two places, changes in thousands, key values in other tables.
ROWS = [(7, 10.2), (505, 401.0), (655, 402.5), (624, 9000.1), (625, 3.9), (62, 4400.0), (899044, 4400.0), (898400, 88.0), (90, 4000.4), (90_051, -4750.0), (21600, 8400.0), (21601, 8400.0)]


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    import os

    at = tmp_path_factory.mktemp("tables")
    for name in os.listdir(sf):
        if name.endswith(".parquet") and name != "supplier.parquet":
            os.symlink(f"{sf}/{name}", at / name)
    spark.createDataFrame(ROWS, "s_suppkey bigint, s_acctbal double").coalesce(1).write.parquet(str(at / "supplier.parquet"))
    con = connect(sf)
    con.execute(f"CREATE OR REPLACE VIEW supplier AS SELECT * FROM read_parquet('{at}/supplier.parquet/*.parquet')")
    return str(at), con


@pytest.mark.parametrize("name", ["audited_changes", "audited_locations", "traced_numbers", "lateral_passages"])
def test_numbers_that_coincide(name, spark, tables):
    registry = lateral.registry if name == "lateral_passages" else filings.registry
    check(registry.queries[name](spark, tables[0]), tables[1], registry.sql[name])
