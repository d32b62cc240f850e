import pytest

from tests.oracle import same
from tributary.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], sf)
