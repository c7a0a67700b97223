import pytest

from lexmill.llm import queries
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001") is None
