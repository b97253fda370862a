"""Every query with a SQL form gives the rows that DuckDB gives."""

import pytest

from evidara.queries import ORACLE_SQL, QUERIES

from .harness import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    compare(spark, con, QUERIES[name], ORACLE_SQL[name], FOLDER)
