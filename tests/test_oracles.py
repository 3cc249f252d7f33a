"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import math
import numbers
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tonearm.plans import analysis, catalog, jobs, scoring

DIR = "/root/testdata/sf0.001"
QUERIES = catalog.QUERIES | scoring.QUERIES | jobs.QUERIES | analysis.QUERIES
ORACLES = catalog.ORACLES | scoring.ORACLES | jobs.ORACLES | analysis.ORACLES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(df):
    def told(v):
        if np.ndim(v) == 0 and pd.isna(v):
            return "~"
        number = isinstance(v, numbers.Real) and not isinstance(v, (bool, np.bool_))
        return f"{v + 0.0:.5f}" if number and math.isfinite(v) else str(v)  # a column with nulls is one of floats

    df = df[sorted(df.columns)]
    return sorted(tuple(map(told, r)) for r in df.itertuples(index=False)), list(df.columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, db, name):
    assert rows(QUERIES[name](spark, DIR).toPandas()) == rows(db.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).limit(5).count() > 0
