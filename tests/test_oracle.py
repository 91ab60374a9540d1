import pytest

import __spark_entry__ as entry
from tests.oracle import connect, same

QUERIES = {k: (f, m.ORACLE.get(k)) for m in entry.core_modules() for k, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_against_sql(spark, sf, con, name):
    query, sql = QUERIES[name]
    if sql is None:
        assert query(spark, sf).columns
    else:
        same(spark, con, query, sql, sf)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
