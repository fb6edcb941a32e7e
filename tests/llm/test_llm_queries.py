"""The package's queries against their SQL on the smallest tables."""

import os

import pytest

from oracle import compare, connect
from stockloom.llm import queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    mine = queries.QUERIES[name](spark, SF_DIR).toArrow()
    if name in queries.ORACLES:
        assert compare(mine, connect(SF_DIR).sql(queries.ORACLES[name]).to_arrow_table()) is None
    else:
        assert mine.num_rows > 0
