"""Every registered query with SQL gives what its SQL gives."""

import pytest

import __spark_entry__ as entry
from airgrid.plans.catalog import SQL
from check import canonical
from conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, duck):
    got = canonical(entry.queries()[name](spark, SF_DIR).toPandas())
    want = canonical(duck.sql(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        assert got[c].equals(want[c]), f"{c}\n{got[got[c] != want[c]].head()}\n{want[got[c] != want[c]].head()}"


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
