"""Every query with SQL gives the SQL's rows."""

import duckdb
import pytest

import __spark_entry__
from hunkwise.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(__spark_entry__.oracle_sql())))
def test_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), db.sql(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
