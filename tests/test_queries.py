"""Every query beside its SQL on the smallest tables; the entry; names agree."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences

from folioworks.plans import registry

NAMES = sorted(registry.queries())
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    df = registry.queries()[name](spark, sf)
    if name in SQL:
        assert differences(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
