"""Every key with oracle SQL agrees with DuckDB on sf0.001."""

import os

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    s_rows, s_cols = rows_of(df.columns, df.collect())
    res = con.execute(E.oracle_sql()[key])
    d_rows, d_cols = rows_of([d[0] for d in res.description], res.fetchall())
    assert s_cols == d_cols
    assert s_rows == d_rows
