"""Every query against its SQL on the smallest tables; the session's time zone is not UTC on purpose."""

from __future__ import annotations

import duckdb
import pytest

from trailknit import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    c.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    return c


def rows(df) -> list:
    k = sorted(df.columns)
    return sorted((tuple(None if x != x else x for x in r) for r in df[k].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, con, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.sql(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
