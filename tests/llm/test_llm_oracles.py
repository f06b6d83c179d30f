import pytest

from oracle import compare
from siltflow.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])
