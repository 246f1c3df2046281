"""Every query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from basinspark import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df, cols):
    df = df[cols].copy()
    for c in cols:
        if df[c].dtype.kind in "fiu":
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].astype(str).str.replace(" 00:00:00", "").replace({"nan": "None", "<NA>": "None", "NaT": "None"})
    return df.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("query", catalog.ALL, ids=lambda q: q.name)
def test_query(spark, duck, query):
    got = query.run(spark, SF).toPandas()
    assert list(got.columns) == [c.split(":")[0] for c in query.columns.split()]
    if query.sql is None:
        assert len(got)
        return
    want = duck.sql(query.oracle()).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = plain(got, cols), plain(want, cols)
    assert len(a) == len(b)
    for c in cols:
        if a[c].dtype.kind == "f" and b[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c], rtol=1e-9, atol=2e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
