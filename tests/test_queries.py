"""Every query with SQL against DuckDB on the same tables."""

import duckdb
import pytest

from semspark.queries import ORACLES, QUERIES, TABLES


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda v: "None" if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, duck, name):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours).equals(normal(theirs))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns
