"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
core = entry.registry


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    found = df.collect()
    if name in core.SQL:
        want = duck.sql(core.SQL[name])
        columns = sorted(df.columns)
        assert columns == sorted(want.columns)
        at = [want.columns.index(c) for c in columns]
        assert sorted((tuple(plain(r[c]) for c in columns) for r in found), key=repr) == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_of_sql_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
