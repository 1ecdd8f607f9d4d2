"""Every registered query against its SQL counterpart, over whole small tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tallymart.plans import oracle, registry
from tests.oracle_check import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    with connect(FOLDER) as con:
        yield con


def test_each_query_has_sql():
    assert registry.queries().keys() == oracle.oracle_sql().keys()
    assert registry.queries().keys() <= contract.queries().keys()


def test_entry(spark):
    assert contract.entry(spark).columns == ["category", "revenue", "qty", "order_count"]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    assert difference(contract.queries()[name](spark, FOLDER), duck, contract.oracle_sql()[name]) is None
