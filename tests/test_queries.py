"""Every query that SQL can express against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from wharfline import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        at = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


def rows(df):
    cols = sorted(df.columns)
    plain = lambda v: repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    df = df[cols].astype(object)
    return cols, sorted(tuple(plain(v) for v in r) for r in df.where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = rows(catalog.queries()[name](spark, SF).toPandas())
    want = rows(duck.execute(catalog.oracle_sql()[name]).fetchdf())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
