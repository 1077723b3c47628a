"""Every registered query against its SQL twin on the smallest given tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

import __spark_entry__ as registered
from registry.core import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    return connect(SF)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == registered.oracle_sql().keys() - {"pipeline"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, oracle, name):
    frame = registered.queries()[name](spark, SF)
    assert difference(frame, oracle, registered.oracle_sql()[name]) is None


def test_entry(spark):
    assert registered.entry(spark).count() == 5
