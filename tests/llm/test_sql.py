"""The operators with SQL return what DuckDB returns."""

import duckdb
import pytest

from lexispark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, small, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        duck.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = duck.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, small).select(*want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
