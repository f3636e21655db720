"""Queries of this subpackage against their SQL over the smallest tables."""

import glob
import os

import duckdb
import pytest

from lorewell.llm import queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_merkle_manifest"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f).removesuffix('.parquet')} as select * from '{f}'")
    found = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
