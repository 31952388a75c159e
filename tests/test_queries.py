"""Every registered query next to its SQL twin, by value."""

from __future__ import annotations

import pytest
from compare import compare, connect
from conftest import SF

import __spark_entry__ as entry
from sparkguard.plans.registry import builders, twins

QUERIES = builders()
TWINS = twins()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    ok, text = compare(spark, con, SF, key, QUERIES[key], TWINS.get(key))
    assert ok, text


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES) <= set(entry.queries())
