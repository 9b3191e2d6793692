"""Every query outside the training-data package against its SQL."""

import os

import pytest

from corpusmill.plans import registry
from tests.oracle import difference, views

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    return views(FOLDER)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, FOLDER)
    if name in registry.ORACLES:
        assert difference(df, con, registry.ORACLES[name]) == ""
    else:
        df.collect()


def test_entry(spark, con):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
