"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

from threadloom import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = ("conversations", "documents", "events")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(df, columns):
    return sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, oracle, name):
    mine, other = catalogue.QUERIES[name](spark, DATA).toPandas(), oracle.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine, sorted(mine.columns)) == rows(other, sorted(mine.columns))
