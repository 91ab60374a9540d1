import pytest

from quern.llm.queries import ORACLE, QUERIES
from quern.runtime import scope
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_against_sql(spark, sf, con, name):
    if name in ORACLE:
        same(spark, con, QUERIES[name], ORACLE[name], sf)
    else:
        with scope():  # their rules are queries with SQL of their own, p6_invariants and p7_invariants, or tests of the operator
            assert QUERIES[name](spark, sf).count() > 0
