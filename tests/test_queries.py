"""Every query that has SQL gives the SQL's rows on the smallest tables; the others run and repeat themselves."""

import os

import duckdb
import pandas as pd
import pytest

from caseloom.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


def shown(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, str):
        return v
    if hasattr(v, "isoformat"):
        return str(v)
    return f"{float(v):.9g}"


def rows(frame):
    return sorted((tuple(shown(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, con, name):
    got, want = catalogue.queries()[name](spark, DIR).toPandas(), con.sql(catalogue.oracle_sql()[name]).df()
    assert set(got.columns) == set(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_repeats_itself(spark, name):
    first = catalogue.queries()[name](spark, DIR).toPandas()
    assert len(first) and rows(first) == rows(catalogue.queries()[name](spark, DIR).toPandas())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
