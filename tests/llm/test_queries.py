"""The queries of the subpackage against their SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from velamen.llm import queries

SF = os.environ.get("VELAMEN_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", [n for n in queries.SQL if n != "op1_ngram_jaccard_links"])
def test_query(spark, name):
    if not glob.glob(f"{SF}/*.parquet"):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    found = con.execute(queries.SQL[name])
    order = [[c[0] for c in found.description].index(c) for c in columns]
    assert got and got == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
