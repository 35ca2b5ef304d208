"""Every query beside its DuckDB twin on the smallest tables, and results that aren't trivial."""

import os

import duckdb
import pytest

from riskweave import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def rows(frame):
    def plain(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__.startswith(("float", "int")) or isinstance(v, int) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(map(repr, (tuple(plain(v) for v in r) for r in frame.itertuples(index=False))))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_detail_of_every_filing(spark):
    want = spark.read.parquet(f"{SF}/orders.parquet").count()
    got = QUERIES["filing_detail"](spark, SF)
    assert got.count() == want and got.where("candidate_ids IS NOT NULL").count() > want // 2


def test_the_bundle_expands_once(spark):
    plan = QUERIES["stats_bundle"](spark, SF)
    plan.collect()
    shown = plan._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert shown.count("Expand ") == 1 and "Reused" in shown
