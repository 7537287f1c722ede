"""Every registered query against its SQL twin."""

import os

import pytest

from compare import both_sides, duck
from hearthstat.plans.queries import QUERIES
from hearthstat.plans.twins import TWINS

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(spark, connection, name):
    spark_columns, duck_columns, spark_rows, duck_rows = both_sides(
        spark, connection, QUERIES[name], TWINS[name], SF_DIR
    )
    assert spark_columns == duck_columns
    assert spark_rows == duck_rows
    assert spark_rows
