"""Every query with an oracle against DuckDB, and the shape of the plans."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from kerbline.plans.all_queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    text = lambda v: None if v is None or (isinstance(v, float) and v != v) or v is pd.NA else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(str(tuple(map(text, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0


#: Joins with one-row or small tables of statistics may be nested loops.
ONE_ROW = {"intensity_p93_filter", "z_band_p05", "filter_waterfall", "cdf_histogram"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ONE_ROW))
def test_no_pairwise_joins(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filter_reaches_the_scan(spark):
    from kerbline.plans import bridge

    plan = bridge.entities(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan.split("ReadSchema")[1]


def test_queries_read_whole_tables():
    from kerbline.plans import bridge

    assert not any(name.endswith("_all") for name in QUERIES)
    assert "%" not in bridge.with_views("SELECT * FROM v_entities").split("FROM customer")[1].split(")")[0]
