"""Every registered catalog query against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from oracle import connect, same

from lattix.plans import registry

NAMES = sorted(registry.load())


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in NAMES if n in registry.ORACLES])
def test_matches_sql(spark, sf, con, name):
    same(registry.QUERIES[name](spark, sf), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", [n for n in NAMES if n not in registry.ORACLES])
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as lib

    assert 0 < lib.entry(spark).count() <= 20
    assert set(lib.oracle_sql()) <= set(lib.queries())
