"""Every named query against its SQL over the same tables."""

import collections
import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from crawlops.fixtures import BASE
from tests.conftest import SMALL

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else ("float", value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck):
    ours = QUERIES[name](spark, SMALL)
    columns = sorted(ours.columns)
    found = collections.Counter(tuple(plain(r[c]) for c in columns) for r in ours.collect())
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    wanted = collections.Counter(tuple(plain(r[i]) for i in places) for r in cursor.fetchall())
    assert found == wanted


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
