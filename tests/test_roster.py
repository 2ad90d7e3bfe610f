"""Every query of the library against its SQL in another engine."""

import duckdb
import pandas as pd
import pytest

from samplight.plans import roster

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("orders", "events", "lineitem", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(roster.ORACLE_SQL))
def test_matches_sql(spark, db, name):
    got, want = roster.QUERIES[name](spark, DIR).toPandas(), db.sql(roster.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=0.011)
