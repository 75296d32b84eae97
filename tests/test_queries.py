"""Every registered query of the core runs over the smallest tables, and equals its SQL."""

import os

import duckdb
import pytest

from folioflow import oracle, queries

DATA = "/root/testdata/sf0.001"


def plain(rows):
    def one(x):
        return float(f"{x:.5g}") if isinstance(x, float) or type(x).__name__ == "Decimal" else x

    return sorted(str([one(x) for x in r]) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    out = queries.QUERIES[name](spark, DATA)
    columns = sorted(out.columns)
    rows = out.select(*columns).collect()
    if name in oracle.SQL:
        expected = con.execute(oracle.SQL[name])
        names = [c[0] for c in expected.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert plain([r[i] for i in order] for r in expected.fetchall()) == plain(rows)
