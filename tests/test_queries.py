"""Queries against their SQL, on the smallest tables."""

import datetime

import duckdb
import pytest

from faktum.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    out.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


def plain(value):
    return value.replace(tzinfo=None) if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    ours = QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    rows = lambda own: sorted(repr(tuple(map(plain, r))) for r in own)
    assert rows(ours.select(*columns).collect()) == rows(want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.limit(1).count() == 1 and len(set(df.columns)) == len(df.columns)
