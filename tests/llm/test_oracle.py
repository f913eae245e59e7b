import pytest

from larkspur.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, differ

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_agrees_with_its_sql(spark, name):
    assert differ(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name]) == ""
