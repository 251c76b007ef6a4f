"""Every registered query with SQL gives the rows that DuckDB gives; the others run and give rows."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from quern.plans.registry import all_queries

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {q.name: q for q in all_queries()}
SLOW = {"l1_boosted_classifier", "l2_boosted_regression", "l3_text_classifier"}

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (float, int, np.number)) and not isinstance(v, (bool, np.bool_)) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if hasattr(v, "__iter__") and not isinstance(v, (str, bytes)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_rows(spark, duck, name):
    ours, theirs = QUERIES[name].run(spark, D).toPandas(), duck.execute(QUERIES[name].sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.astype(object)) == rows(theirs.astype(object))


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql and n not in SLOW])
def test_gives_rows(spark, name):
    assert QUERIES[name].run(spark, D).count() > 0


def test_names_are_unique():
    assert len(QUERIES) == len(all_queries())
