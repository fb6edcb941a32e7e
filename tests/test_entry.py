"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    mine = QUERIES[name](spark, SF_DIR).toArrow()
    if name in ORACLES:
        assert compare(mine, duck.sql(ORACLES[name]).to_arrow_table()) is None
    else:
        assert mine.num_rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 31
    assert df.count() > 0
