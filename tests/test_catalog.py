"""Every catalogue query against its SQL, on the smallest tables."""

import pytest

from flowlens.catalog import catalog
from tests.compare import compare, connect

QUERIES = catalog()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, QUERIES[name], sf_dir) == ""


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, sf_dir, name):
    assert QUERIES[name].run(spark, sf_dir).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).columns == ["ipsrc", "total_flows", "unique_dst_ports", "denies", "scan_score"]
