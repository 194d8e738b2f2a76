"""Every query of the subpackage with SQL gives on the smallest tables what DuckDB gives."""

import glob
import os

import duckdb
import pytest

from talkloom.llm import queries

FOLDER = "/root/testdata/sf0.001"


def plain(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(str, df.itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert plain(queries.QUERIES[name](spark, FOLDER).toPandas()) == plain(c.execute(queries.ORACLE_SQL[name]).df())
