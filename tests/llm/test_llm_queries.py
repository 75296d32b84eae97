"""Every registered query runs over the smallest tables, and those with SQL equal it."""

import duckdb
import pytest

import __spark_entry__
from folioflow.llm import oracle, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    out = queries.QUERIES[name](spark, DATA)
    rows = out.collect()
    assert len(rows) == len({str(r) for r in rows})
    if name in oracle.SQL:
        con = duckdb.connect()
        for table in ("docs", "passages", "vectors", "documents", "eval_items"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        expected = con.execute(oracle.SQL[name])
        names = [c[0] for c in expected.description]
        assert sorted(map(str, expected.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in rows)


def test_registered():
    assert queries.QUERIES.items() <= __spark_entry__.queries().items()
