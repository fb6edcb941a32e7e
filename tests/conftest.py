import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from stockloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def frame(spark):
    """Build a DataFrame from rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture()
def unmerged(spark):
    """Joins by shuffle only; gives the tasks that rows are dealt to where they must not be merged by size."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(n, None) for n in names]
    for n in names:
        spark.conf.set(n, "-1")
    yield 4 * spark.sparkContext.defaultParallelism
    for n, value in zip(names, before):
        spark.conf.unset(n) if value is None else spark.conf.set(n, value)
