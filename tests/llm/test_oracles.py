import glob
import os

import duckdb
import pytest

from pagewright.llm import queries

from ..test_oracles import rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns[got.dtypes == "float64"]:
        got[c] = got[c].astype("Int64")  # integers with nulls
    assert rows(got) == rows(want)
