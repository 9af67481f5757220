"""Every query with SQL against it; the shared shapes of all."""

import pytest
from helpers import same

from larkspur.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, data, duck, name):
    assert same(registry.QUERIES[name](spark, data), duck, registry.ORACLE_SQL[name]) > 0
