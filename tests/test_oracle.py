"""Every registered game-log query against its SQL in DuckDB, at the smallest scale."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb
import pytest

from tabletide.plans import queries as plans

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else round(v, 6) if isinstance(v, float) else v


def by_text(rows):
    return sorted(rows, key=lambda x: [(v is None, str(v)) for v in x])


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    rows = [tuple(map(plain, r)) for r in df.select(*sorted(df.columns)).collect()]
    found = duck.sql(plans.oracle_sql()[name])
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    assert {c: TYPES[t] for c, t in df.dtypes} == {c: str(found.types[i]) for i, c in enumerate(found.columns)}
    assert by_text(rows) == by_text(tuple(plain(x[i]) for i in order) for x in found.fetchall())
