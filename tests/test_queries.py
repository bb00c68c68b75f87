"""Every query against its SQL, on the smallest data."""

import datetime as dt
import math
from decimal import Decimal

import duckdb
import pytest

from lattica import queries
from lattica.sources.tpch import TABLES


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folder, duck, name):
    df = queries.QUERIES[name](spark, folder)
    got = sorted(([plain(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=repr)
    if name not in queries.SQL:
        assert got
        return
    rel = duck.sql(queries.SQL[name])
    names = list(rel.columns)
    assert sorted(df.columns) == sorted(names)
    want = sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in rel.fetchall()), key=repr)
    assert got == want


def test_entry(spark, folder):
    assert queries.entry(spark, folder).count() == 25
