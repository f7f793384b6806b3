"""Every registered query of the ticket engine against its SQL in DuckDB."""

import math
from pathlib import Path

import pytest

from ticketflow.catalogue import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(columns).collect()), key=str)
    if name not in ORACLES:
        assert got
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(map(plain, r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)
    assert got == want
