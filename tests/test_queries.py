"""Every query of the grid engine beside its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from quadrille.plans.queries import QUERIES, SQL


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return str(bool(v)) if isinstance(v, bool) else repr(float(v) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(tuple(_plain(v) for v in row) for row in frame.select(*columns).collect())
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    want = sorted(tuple(_plain(v) for v in row) for row in relation.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got == want
