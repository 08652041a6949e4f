"""Every registered query with a SQL twin gives the twin's rows on the smallest tables."""

from __future__ import annotations

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    verdict, detail = compare.compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert verdict == "exact", detail


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
