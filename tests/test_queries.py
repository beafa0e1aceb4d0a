"""Every registered query of the findings engine against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from sieveline.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def _rows(rows, columns):
    plain = [tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    types = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    columns = sorted(df.columns)
    got = _rows([r.asDict() for r in df.collect()], columns)
    assert got == _rows([dict(zip(want.columns, r)) for r in want.fetchall()], columns)


def test_flagship_has_rows(spark):
    assert catalog.flagship(spark, FOLDER).count() > 0
