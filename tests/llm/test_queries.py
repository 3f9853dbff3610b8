"""Queries of the text operators that SQL can express, and the registry."""

import pytest

import __spark_entry__ as entry
from gridlore.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf_dir, same, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.SQL[name])


def test_each_operator_has_one_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
