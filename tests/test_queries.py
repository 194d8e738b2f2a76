"""Every core query with SQL gives on the smallest tables what DuckDB gives; composites run and hold their bounds."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from talkloom.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(df):
    def value(v):
        if pd.isna(v):
            return None
        if type(v).__name__ in ("bool", "bool_"):
            return bool(v)
        return v if isinstance(v, str) else float(v) if hasattr(v, "__float__") else str(v)
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted((tuple(value(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert plain(registry.QUERIES[name](spark, FOLDER).toPandas()) == plain(duck.execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    rows = registry.QUERIES[name](spark, FOLDER).collect()
    for r in rows:
        for c in ("proportion", "share", "low", "high"):
            assert c not in r.__fields__ or r[c] is None or (0 <= r[c] <= 1 and not math.isnan(r[c]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
