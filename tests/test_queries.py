"""Every query against its oracle on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def _names():
    from farwheel import catalog

    return sorted(catalog.QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query(spark, name):
    from farwheel import catalog

    got = catalog.QUERIES[name](spark, SF).toPandas()
    sql = catalog.ORACLE_SQL.get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = connect(SF).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
