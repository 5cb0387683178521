"""Every registered query against its SQL on the smallest supplied tables."""

import pytest
from conftest import DATA
from oracle import compare, connection

from caseweave.plans.catalog import registered

FOLDER = f"{DATA}/sf0.001"
QUERIES = registered()


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    query, sql = QUERIES[name]
    if sql is None:
        assert query(spark, FOLDER).count() > 0
    else:
        assert compare(spark, con, FOLDER, query, sql) == ""


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0
