"""Every registered core query: its SQL gives the same rows, or without SQL it gives some."""

from __future__ import annotations

import pytest
from oracle import compare, connect

from tessella import quality_queries
from tessella.queries import collect

QUERIES, SQL = collect()
QUERIES, SQL = QUERIES | quality_queries.QUERIES, SQL | quality_queries.SQL


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, tiny, con, name):
    compare(QUERIES[name](spark, tiny), SQL[name], con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, tiny, name):
    assert QUERIES[name](spark, tiny).columns
    assert QUERIES[name](spark, tiny).count() >= 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_without_subpackage(monkeypatch, tiny, spark):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "tessella.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES)
    assert entry.entry(spark).columns
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
