"""Every registered query equals its DuckDB twin on sf0.001 (order-insensitive)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, canon
from webreach.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
Q = E.queries()
O = {name: sql for name, sql in E.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(O))
def test_query_matches_oracle(spark, con, name):
    df = Q[name](spark, SF)
    cur = con.execute(O[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    srows = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(dcols)
    assert canon(df.columns, srows) == canon(dcols, drows)


def test_every_query_has_an_oracle():
    from webreach.plans.registry import ORACLE, QUERIES
    assert set(QUERIES) - set(ORACLE) <= {"stream_url_list", "stream_page_candidates"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["input_pos", "website", "email", "phone", "summary"]
    assert df.count() > 0
