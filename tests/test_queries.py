import pytest

from larkspur.queries import QUERIES, SQL

from .oracle import connect, differ

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_its_sql(spark, con, name):
    assert differ(QUERIES[name](spark, SF), con, SQL[name]) == ""
