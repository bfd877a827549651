"""Every query that has SQL gives what DuckDB gives on the same tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from tessaria import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(df):
    df = df[sorted(df.columns)]
    number = lambda v: isinstance(v, numbers.Real) and not isinstance(v, bool)
    show = lambda v: "null" if v is None or v is pd.NA or v is pd.NaT or v != v else f"{float(v):.6f}" if number(v) else str(v)
    return sorted(tuple(show(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(name, spark, duck, sf_dir):
    got, want = plans.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_without_oracle(name, spark, sf_dir):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "best_doc", "best_score", "first_rank"]
    assert set(e.oracle_sql()) <= set(e.queries()) and os.path.exists(e.__file__)
