"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, connect
from conftest import SMALL

import __spark_entry__ as driver
from proofline import plans

QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return connect(SMALL)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert len({name.split("_")[0] for name in QUERIES}) == 119


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    problem = compare(QUERIES[name](spark, SMALL), tables, ORACLE[name])
    assert problem is None, problem


def test_entry(spark):
    assert driver.entry(spark).count() > 0
