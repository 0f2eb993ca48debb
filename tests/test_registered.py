"""Every registered query of the library against its DuckDB SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from transitlake.plans import fitted, registered, runs  # noqa: F401 (all register their own)

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_query_matches_sql(spark, duck, name):
    got = registered.QUERIES[name](spark, SF)
    want = duck.sql(registered.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, (int, float)) and abs(u - v) <= 2e-4) or (isinstance(v, float) and abs(u - v) <= 2e-4), (x, y)
