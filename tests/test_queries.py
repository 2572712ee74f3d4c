"""Every query against its SQL on the smallest tables; those without SQL must run."""

from __future__ import annotations

import pytest

from foliolake.plans import registry

from .conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, compare):
    compare(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(name, spark):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 200
