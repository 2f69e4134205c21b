"""Every registered query with SQL against DuckDB, on whole tables."""

import pytest

from lorekeep.plans import core_queries, flow_queries  # noqa: F401

from .oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(core_queries.SQL))
def test_query_equals_sql(spark, name):
    compare(core_queries.QUERIES[name](spark, f"{DATA}/sf0.001"), core_queries.SQL[name], "sf0.001")


def test_every_note_comes_back(spark):
    rows = core_queries.QUERIES["frontmatter_roundtrip"](spark, f"{DATA}/sf0.01").collect()
    assert len(rows) == 600 and all(r[f"same_{c}"] for r in rows for c in ("scope", "value", "source", "tags", "origin", "body"))
