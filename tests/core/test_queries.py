"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tideline.plans.queries import QUERIES, SQL

SF = os.environ.get("TIDELINE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(names, table):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([r[i] for i in order]) for r in table)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    have, need = rows(got.columns, got.collect()), rows(names, want.fetchall())
    assert len(have) == len(need)
    assert [x for x in zip(have, need) if x[0] != x[1]][:2] == []
