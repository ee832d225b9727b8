"""Every query equals its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from wikilake.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def _rows(df):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "year"):
            return str(pd.Timestamp(v))
        try:
            return f"{float(v):.6g}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(one, r)) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name not in catalog.SQL:
        assert len(got.columns)
        return
    want = duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
