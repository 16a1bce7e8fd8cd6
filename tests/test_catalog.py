"""Every registered query against its DuckDB oracle, and the entry point."""

import duckdb
import pytest

from panelwright import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(names, tuples):
    order = sorted(range(len(names)), key=names.__getitem__)
    flat = lambda v: tuple(v) if isinstance(v, list) else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(flat(t[i]) for i in order) for t in tuples), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, oracle, name):
    df = catalog.QUERIES[name](spark, data)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.ORACLES:
        assert got
        return
    want = oracle.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == rows(want.columns, want.fetchall())


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
