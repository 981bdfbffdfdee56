"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from scanloom.catalog import ORACLES, QUERIES

TABLES = ("embeddings", "orders")


def rows(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, small, name):
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    found = QUERIES[name](spark, small).toPandas()
    want = db.sql(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(rows(found), rows(want), check_dtype=False)


@pytest.mark.parametrize("name", ["spectral_node_desc", "hungarian_match", "sequence_retrieval"])
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
