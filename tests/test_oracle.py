"""Every core query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from quernstone.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return str(v) if isinstance(v, (list, tuple, dict)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name in catalog.oracle_sql():
        r = duck.sql(catalog.oracle_sql()[name])
        at = [r.columns.index(c) for c in columns]
        want = [tuple(plain(x[i]) for i in at) for x in r.fetchall()]
        order = lambda rows: sorted(rows, key=lambda t: tuple((v is None, str(v)) for v in t))
        assert order(got) == order(want)
    else:
        assert got
