"""Registered queries by family; each names the SQL it is held against."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("scan", "joins", "aggregates", "windows", "reshape", "identity", "values", "stats", "alignment", "graph", "models", "streams")


def collect() -> tuple[dict, dict]:
    """All queries, and the SQL of those that have one."""
    queries, sql = {}, {}
    for family in FAMILIES:
        module = import_module(f"{__name__}.{family}")
        queries |= module.REGISTRY.queries
        sql |= module.REGISTRY.sql
    return queries, sql
