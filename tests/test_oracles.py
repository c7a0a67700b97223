"""Every query that has SQL equals it over sf0.001; the others run and keep their schema."""

import pytest

from lexmill.plans import registry
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert differences(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert len(df.columns) == len(set(df.columns))
    df.write.format("noop").mode("overwrite").save()
