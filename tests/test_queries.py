"""Every query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from sparkvision.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(df.columns)
    df = df[columns].astype(object)
    return df.where(df.notna(), None).astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    expected = duck.execute(registry.SQL[name]).df()
    pd.testing.assert_frame_equal(ordered(got), ordered(expected))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
