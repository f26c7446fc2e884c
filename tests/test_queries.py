"""Every query of the library against its SQL on the smallest tables."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from lattica.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return f"{float(v):.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, sf, oracle, name):
    got = QUERIES[name](spark, sf)
    cursor = oracle.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, cursor.fetchall())
