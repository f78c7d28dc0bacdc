import pytest

from oracle import same
from speechloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, data, name):
    same(spark, data, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_gives_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
