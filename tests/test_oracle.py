"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from cytoloom import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = sorted(plans.ORACLE)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    want, got = con.sql(plans.ORACLE[name]).df(), plans.QUERIES[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    order = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(want), order(got), check_dtype=False, atol=2e-6, rtol=1e-9)
