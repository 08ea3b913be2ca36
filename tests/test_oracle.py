"""Every query with SQL gives the rows that DuckDB gives."""

import oracle
import pytest

import __spark_entry__ as entry
from twinlens.catalog import load

REGISTRY = load()
CHECKED = [n for n, q in REGISTRY.items() if q.sql]


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, con, name):
    got = REGISTRY[name].run(spark, sf).toPandas()
    assert oracle.compare(got, con.execute(REGISTRY[name].sql).df()) == []


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
