"""Queries of the subpackage that SQL can express, and every other one once, on whole tables."""

import pytest

from lorekeep.llm import queries
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    compare(queries.QUERIES[name](spark, f"{DATA}/sf0.001"), queries.SQL[name], "sf0.001")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, f"{DATA}/sf0.001").count() >= 0
