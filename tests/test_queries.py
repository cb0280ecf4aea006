"""Every query with SQL against DuckDB on the smallest tables, and rows of the others."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from triagelake import oracles, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(df):
    def one(v):
        if not isinstance(v, (list, tuple)) and pd.isna(v):
            return "null"
        if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "dtype"):
            return str(v).removesuffix(" 00:00:00")
        return f"{float(v):.6f}"

    df = df[sorted(df.columns)]
    return sorted(tuple(one(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracles.sql()))
def test_equals_sql(spark, duck, name):
    got, want = queries.queries()[name](spark, SMALL).toPandas(), duck.sql(oracles.sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracles.sql())))
def test_has_rows(spark, name):
    assert queries.queries()[name](spark, SMALL).count() > 0
