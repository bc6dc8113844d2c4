"""Every query with SQL agrees with DuckDB on the same tables; the others give rows."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v.values() if isinstance(v, dict) else v))
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return bytes(v) if isinstance(v, bytearray) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    got = rows(df.columns, df.collect())
    if name not in SQL:
        assert got[1]
        return
    c = duck.execute(SQL[name])
    want = rows([x[0] for x in c.description], c.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]) and want[1]
    for a, b in zip(got[1], want[1]):
        assert a == b
