"""Every query with SQL against DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "isoformat"):
        return str(x)
    return round(float(x), 6) if isinstance(x, float) else int(x) if hasattr(x, "item") and "int" in type(x).__name__ else x


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"])
def test_query(spark, duck, name):
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
