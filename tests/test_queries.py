"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest
from support import DATA

import __spark_entry__

SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def told(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: "none" if x is None or x is pd.NA or x != x else f"{x:.9g}" if isinstance(x, float) else str(x.tolist() if hasattr(x, "tolist") else x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", [k for k in ORACLES if k != "pipeline"])
def test_query_equals_sql(spark, duck, name):
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    num = lambda df: df.apply(lambda c: c.astype("Float64") if pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c) else c)
    pd.testing.assert_frame_equal(told(num(got)), told(num(want)), check_dtype=False)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
