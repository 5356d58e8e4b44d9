"""Every registered query against its SQL twin, on the smallest data set."""

import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries

# Operators that compare all pairs or run Python per row.
UNWANTED = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
)
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_its_sql(spark, con, name):
    found = compare.check(spark, con, SF_DIR, queries()[name], oracle_sql()[name])
    assert found.problem is None, found.problem
    assert not [word for word in UNWANTED if word in found.plan], found.plan


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert queries()[name](spark, SF_DIR).count() > 0


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns[0] == "metric_window"
