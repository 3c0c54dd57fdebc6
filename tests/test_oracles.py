"""Every registered query with SQL gives the oracle's rows on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from strandflow.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float) and v == int(v):
        return int(v)
    return int(v) if isinstance(v, np.integer) else v if isinstance(v, (int, str, bool, float)) else str(v)


def rows_of(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(_cell(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, oracle, name):
    ours, theirs = catalog.queries()[name](spark, DIR).toPandas(), oracle.sql(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
