"""Queries of the corpus part against their SQL, on the driver's tables."""

import os

import duckdb
import pytest

from spendspark.llm import queries as llm

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df, sql = llm.queries()[name](spark, SF), llm.oracle_sql()[name]
    names = sorted(df.columns)
    assert names == sorted(duck.sql(sql).columns)
    got = sorted(map(tuple, df.select(*names).collect()), key=str)
    assert got == sorted(duck.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall(), key=str) and got
