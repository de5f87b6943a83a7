"""Registered queries against their SQL, run by DuckDB over the same small tables."""

from pathlib import Path

import duckdb
import pytest

from cadenza.plans import registry

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.sql(f"create view {path.stem} as select * from '{path}'")
    return con


def rows(names, found):
    return sorted(repr([r[n] for n in sorted(names)]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, str(SF))
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, (r.asDict() for r in got.collect())) == rows(want.columns, (dict(zip(want.columns, r)) for r in want.fetchall()))
