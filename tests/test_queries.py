"""Every query with SQL gives DuckDB's rows; every query runs."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from parley import catalog


def plain(frame, columns):
    def one(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
            return ""
        return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)

    return sorted(tuple(map(one, row)) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, small, duck, name):
    ours = catalog.QUERIES[name](spark, small).toPandas()
    theirs = duck.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert plain(ours, columns) == plain(theirs, columns)


def test_entry_has_rows(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert frame.count() == 61
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
