"""Each query beside its SQL twin."""

import pytest
from conftest import duck_rows, rows

from wrenfold.plans import registry


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(name, spark, sf, duck):
    found = rows(registry.QUERIES[name](spark, sf))
    if name in registry.SQL:
        assert found == duck_rows(duck.sql(registry.SQL[name]))
    else:
        assert found


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() >= 0
