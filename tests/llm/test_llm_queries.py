import os

import duckdb
import pandas as pd
import pytest

from coweave.llm import plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def normal(df):
    df = df[sorted(df.columns)].copy()
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(autouse=True)
def compiled(spark):
    """Queries run as in production: with code generation."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    found, expected = normal(plans.QUERIES[name](spark, FOLDER).toPandas()), normal(con.sql(plans.ORACLE[name]).df())
    assert len(found) == len(expected)
    if len(found):
        pd.testing.assert_frame_equal(found, expected, check_dtype=False, rtol=0, atol=0)
