"""Every plan against the checking engine over the smallest tables."""

import glob
import os

import duckdb
import pytest

from lorewell.plans import queries, retrieval

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f).removesuffix('.parquet')} as select * from '{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(f"{x:.5f}" if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_plan(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    if name in retrieval.QUERIES:  # searches meet all rows without a product
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    got, want = found.toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_no_plan_is_a_cartesian_product(spark):
    """Overlap joins go through an inverted index."""
    for name in ("l01_lexical_lane", "l05_corpus_lane", "j07_token_overlap_join", "j09_polarity_contradictions", "u10_hybrid_retrieval"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Join" in x and "Cross" in x]


def test_filters_reach_the_scan(spark):
    plan = queries.QUERIES["s09_filtered_cases"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type)" in plan and "props" not in plan
