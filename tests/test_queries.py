"""Each registered query against its SQL on the smallest tables."""

import math
import os

import pytest

from terravela.plans import catalogue_queries, site_queries, terrain_queries

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
QUERIES = terrain_queries.QUERIES | catalogue_queries.QUERIES | site_queries.QUERIES
SQL = terrain_queries.ORACLE_SQL | catalogue_queries.ORACLE_SQL | site_queries.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}" if abs(v) < 1e9 else f"{float(v):.0f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(cell(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(cell(r[i]) for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry_and_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "d8_direction" in entry.queries()
