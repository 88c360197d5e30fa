"""Every registered core query with SQL equals DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from corpuslane.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings paper_records flat_papers parsed_papers prompt_records model_generations sample_targets container_sizes".split()


def norm(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, str):
        return v
    try:
        return round(float(v), 6) + 0.0
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(norm(x) for x in r) for r in df[names].itertuples(index=False, name=None)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(con.execute(registry.oracle_sql()[name]).df())


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())
