"""Queries of the subpackage against their SQL."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare, connect  # noqa: E402

from tessella.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, tiny, name):
    compare(QUERIES[name](spark, tiny), SQL[name], connect(tiny))
