"""Every registered query with SQL against that SQL on the smallest tables; the others must give rows."""

import pytest
from check import compare, connect

import __spark_entry__ as entry_module

SF_DIR = "/root/testdata/sf0.001"
#: Without SQL, and the groups of the smallest tables are under their least size.
LARGER = {"c11_learn_weights", "q16_isolation_forest", "t7_top_predictors"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 8  # four version changes in production and in staging
    assert {r.tier for r in rows} <= {"TIER1", "TIER2", "TIER3"}


def test_names():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query(spark, con, name):
    good, note = compare(spark, con, name, "/root/testdata/sf0.01" if name in LARGER else SF_DIR)
    assert good, note
