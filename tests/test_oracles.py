"""Every registered plan against its SQL on the smallest tables."""

import duckdb
import pytest

from check import norm
from oddsmith.plans import all_oracles, all_queries
from oddsmith.plans.bindings import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("key", sorted(all_queries()))
def test_plan_matches_sql(spark, con, key):
    df = all_queries()[key](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    if key not in all_oracles():
        assert got
        return
    cur = con.execute(all_oracles()[key])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == names
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    assert got == want
