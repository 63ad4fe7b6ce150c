"""Every query with SQL against its SQL, and the others for rows, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import DATA
from oracles import same

from proxima.plans.catalogue import ORACLE_SQL, QUERIES

SMALL = DATA / "sf0.001"
WITHOUT_SQL = sorted(set(QUERIES) - set(ORACLE_SQL))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(spark, QUERIES, ORACLE_SQL, name, SMALL)


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, str(SMALL)).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "cluster", "kind"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
