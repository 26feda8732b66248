"""Every query against its SQL, on the driver's tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from spendspark.plans import registry as own

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    fix = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(fix(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_query_equals_sql(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.sql(own.SQL[name])
    assert names == sorted(want.columns)
    order = ", ".join(f'"{n}"' for n in names)
    assert plain(map(tuple, df.select(*[f"`{n}`" for n in names]).collect())) == plain(duck.sql(f"SELECT {order} FROM ({own.SQL[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_query_runs(spark, name):
    assert own.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
