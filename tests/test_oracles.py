"""Every query with SQL against DuckDB on the small tables; the others must run."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr([plain(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in driver.queries() if n != "pipeline"])
def test_query(spark, db, name):
    got = driver.queries()[name](spark, SF)
    assert len(set(got.columns)) == len(got.columns)
    frame = got.toPandas()
    if sql := driver.oracle_sql().get(name):
        want = db.sql(sql).df()
        assert sorted(want.columns) == sorted(frame.columns)
        assert rows(frame) == rows(want)


def test_entry(spark):
    out = driver.entry(spark)
    assert out.count() > 0 and "saved" in out.columns
