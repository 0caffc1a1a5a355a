"""Each query of the problems tagged llm that has SQL against it, on the smallest tables."""

import pytest

from millrace.llm import queries
from tests.test_queries import DATA, duck, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_its_sql(spark, duck, name):  # noqa: F811
    assert rows(queries.QUERIES[name](spark, str(DATA)).toPandas()) == rows(duck.sql(queries.SQL[name]).df())
