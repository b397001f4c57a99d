"""Every registered query against its SQL, on the smallest scale factor."""

from __future__ import annotations

import os

import pytest
from check_queries import differences, oracle_connection

import __spark_entry__ as entry_points
from proofspark.plans.catalog import QUERIES
from proofspark.plans.oracle import ORACLE_SQL

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


def test_every_query_of_the_library_has_sql():
    """Queries of the subpackage for training data may be tested against brute force instead."""
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", list(entry_points.oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    ours = entry_points.queries()[name](spark, FOLDER).toPandas()
    theirs = oracle.execute(entry_points.oracle_sql()[name]).df()
    assert differences(ours, theirs) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() == 199
