"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = entry.DATA
NAMES = [n for n in entry.oracle_sql() if n not in ("pipeline",) and not n.startswith("op")]


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert rows(entry.queries()[name](spark, DATA).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
