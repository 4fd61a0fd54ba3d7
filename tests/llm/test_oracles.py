"""The corpus operators that have SQL give what DuckDB gives, at the smallest size."""

import os
from collections import Counter

import duckdb
import pytest

from textloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    out = QUERIES[name](spark, SF)
    names = sorted(out.columns)
    got = duck.execute(ORACLE_SQL[name])
    assert {c: KINDS[t] for c, t in out.dtypes} == {x[0]: str(x[1]) for x in got.description}
    at = [[x[0] for x in got.description].index(n) for n in names]
    want = Counter(tuple(r[i] for i in at) for r in got.fetchall())
    assert Counter(tuple(r) for r in out.select(*names).collect()) == want
