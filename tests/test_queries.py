"""Every query of the catalogue against its SQL, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from millrace.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool | str | type(None)):
        return v
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else round(float(v), 8)
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalog.ORACLES:
        assert got
        return
    result = duck.sql(catalog.ORACLES[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_paging_is_a_top_k(spark):
    plan = catalog.QUERIES["active_keyword_page_latest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters" in plan


def test_anti_join_reads_no_text(spark):
    plan = catalog.QUERIES["not_embedded_anti_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "text:string" not in plan
