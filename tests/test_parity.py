"""Every query with SQL gives what DuckDB gives, at the smallest size."""

import os
from collections import Counter

import duckdb
import pytest

from textloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    out = QUERIES[name](spark, SF)
    names = sorted(out.columns)
    got = duck.execute(ORACLE_SQL[name])
    kinds = {x[0]: str(x[1]) for x in got.description}
    assert {c: KINDS[t] for c, t in out.dtypes} == kinds
    at = [[x[0] for x in got.description].index(n) for n in names]
    want = Counter(tuple(r[i] for i in at) for r in got.fetchall())
    assert Counter(tuple(r) for r in out.select(*[f"`{n}`" for n in names]).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
