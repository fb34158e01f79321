"""Every query that has SQL against DuckDB, on the smallest tables."""

import os

import numpy as np
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
        df[c] = df[c].map(lambda v: None if v is None or isinstance(v, float) and np.isnan(v) else str(list(v)) if isinstance(v, (list, np.ndarray)) else str(int(v)) if isinstance(v, (float, np.floating)) and float(v).is_integer() else str(v))
    return df.sort_values(list(df.columns), na_position="last").reset_index(drop=True)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_gives_what_sql_gives(name, spark, db):
    got, want = plain(entry.queries()[name](spark, DATA).toPandas()), plain(db.execute(entry.oracle_sql()[name]).fetchdf())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert got.equals(want), got.merge(want, how="outer", indicator=True).query("_merge != 'both'").head(5).to_string()


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert entry.entry(spark).count() > 0
