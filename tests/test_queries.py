"""Every registered query with check SQL, compared in full with DuckDB."""

import pytest
from compare import SF, compare, connect

from fillcast.catalog import REGISTRY

CHECKED = [n for n, q in REGISTRY.items() if q.sql is not None]


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(name, spark, con):
    assert compare(REGISTRY[name], spark, con, SF) is None


def test_entry_points(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
