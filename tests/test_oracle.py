"""Every query with SQL returns what DuckDB returns."""

import duckdb
import pytest

from lexispark import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str(tuple(r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, small, duck, name):
    got = registry.QUERIES[name](spark, small)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark, monkeypatch):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
