"""Every registered query against its SQL, on the smallest scale."""

import pytest

from catalog.oracles import ORACLES
from catalog.spark_queries import QUERIES
from tests.check_oracles import connect, differences, spark_rows, sql_rows
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, connection, name):
    actual = spark_rows(QUERIES[name](spark, SF_DIR))
    expected = sql_rows(connection, ORACLES[name])
    assert expected[1], "the comparison must not be empty"
    assert differences(actual, expected) == ""
