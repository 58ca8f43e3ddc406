"""Every query of the catalog against its oracle on the smallest tables."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() == 5


def test_oracles_belong_to_queries():
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())
