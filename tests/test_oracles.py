"""Every registered query of the version operators against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog


def _key(row):
    return tuple((x is not None, str(x)) for x in row)


def _norm(x):
    return float(f"{x:.9g}") if isinstance(x, float) and not math.isnan(x) else x


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    want = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(map(_norm, r)) for r in want.fetchall()), key=_key)
    got = sorted((tuple(map(_norm, r)) for r in df.select(*columns).collect()), key=_key)
    assert got == expected
    assert got or name == "get_key"
