"""Every query with SQL gives the SQL's rows over the smallest tables, under a session zone that isn't UTC."""

from __future__ import annotations

import pytest

import __spark_entry__ as e
from tests.compare import compared


@pytest.mark.parametrize("name", list(e.oracle_sql()))
def test_same_rows(spark, sf, name):
    same, left, right = compared(spark, name, sf, e.queries()[name], e.oracle_sql()[name])
    assert same, (sorted(set(left) - set(right))[:3], sorted(set(right) - set(left))[:3])


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    assert e.entry(spark).count() > 0
