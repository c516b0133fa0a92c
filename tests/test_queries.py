"""A spread of bound queries against their oracle; tools/check_queries.py runs them all."""

import os

import duckdb
import pytest

from stratapanel.plans.catalog import ORACLES, QUERIES
from tools.check_queries import TABLES, canonical

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
SAMPLE = ["b3_strategy_suite", "b7_leave_one_out", "w2_capped_simplex", "a9_evaluate", "c1_rank_ic", "q9_all_flags", "j1_interval_join", "b17_capacity_ceilings", "t1_stream_merge"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    a, b = (sorted(range(len(n)), key=lambda i: n[i]) for n in (df.columns, names))
    assert canonical([tuple(r) for r in df.collect()], a) == canonical(cur.fetchall(), b)


def test_entry(spark):
    from __spark_entry__ import entry

    assert len(entry(spark).collect()) == 1
