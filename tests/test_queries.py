"""Every registered query of the main library against its SQL, over the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from duskloom.plans import load
from tools.compare import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as connection:
        for name in TABLES:
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
        yield connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_those_without_sql_run(spark):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
