"""Every registered query of the reaction library against its DuckDB statement on the small tables."""

from __future__ import annotations

import os

import pytest

from rxncurate.plans import registry

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(names, values):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(show(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    values = [tuple(r) for r in got.collect()]
    if name not in registry.ORACLE:
        assert values
        return
    want = con.execute(registry.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, values) == rows(names, want.fetchall())
