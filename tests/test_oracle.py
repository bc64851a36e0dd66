"""Every registered query of the library against its DuckDB SQL."""

import math

import duckdb
import pytest
from conftest import SF

from lodestrata import catalog
from lodestrata.session import TABLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return f"{'int' if isinstance(v, int) else type(v).__name__}:{v}"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    got = duck.execute(sql)
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    assert rows == sorted(tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in got.fetchall())
