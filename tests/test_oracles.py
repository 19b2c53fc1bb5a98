"""Every query against its oracle, on the smallest tables."""

import math
import os

import pandas as pd
import pytest

from quern import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(df):
    def one(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, float):
            return f"{v + 0.0:.5f}"
        if isinstance(v, pd.Timestamp):
            return str(v)
        return str(list(v)) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(one, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = rows(QUERIES[name](spark, DATA).toPandas())
    if name not in ORACLES:
        assert got[0]
        return
    want = rows(duck.sql(ORACLES[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(x == y or _close(x, y) for x, y in zip(a, b)), (a, b)


def _close(x, y):
    try:
        return abs(float(x) - float(y)) <= 2e-5  # the last rounded place
    except ValueError:
        return False


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
