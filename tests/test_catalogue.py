"""Every registered query against its SQL counterpart, over whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from tallyspark.plans.catalogue import QUERIES
from tests.compare import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) <= set(entry_point.queries())
    assert set(QUERIES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert spark_rows(entry_point.queries()[name](spark, SF)) == duck_rows(duck, entry_point.oracle_sql()[name])


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
