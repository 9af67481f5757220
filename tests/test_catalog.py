"""Every query of the catalogue against its SQL."""

import pytest
from helpers import same

from larkspur import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    if name in catalog.ORACLE_SQL:
        same(df, duck, catalog.ORACLE_SQL[name])
    else:
        assert df.columns and df.count() >= 0
