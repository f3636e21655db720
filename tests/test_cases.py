"""Similar cases among all, and requests timed to the nearest second."""

import datetime as dt
import glob
import os
import tempfile

import duckdb
import pytest

from lorewell.operators import nearest
from lorewell.plans import queries


@pytest.fixture(scope="module")
def folder():
    """Tables of a few rows: events (event_id, seconds, user_id, event_type, value) and pages."""
    path = tempfile.mkdtemp(prefix="spark-")
    con = duckdb.connect()
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    for i, s, user, kind, value in [(0, 11.2, 50, "view", 1.0), (1, 60 * 3600 + 10.7, 0, "click", 2.0), (2, 60 * 3600 + 10.2, 0, "purchase", 3.0), (3, 60 * 3600 + 11.5, 100, "purchase", 3.0)]:
        con.execute("insert into events values (?, ?, ?, ?, ?, '{\"k\": 1}')", [i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), user, kind, value])
    con.execute("create table pages as select * from (values (0, 'u', 'h'), (60, 'u', 'h'), (1, 'u', 'h')) t(page_id, url, html)")
    for name in ("events", "pages"):
        con.execute(f"copy (select * from {name}) to '{path}/{name}.parquet' (format parquet)")
    return path


def compared(spark, folder, name):
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f).removesuffix('.parquet')} as select * from '{f}'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    got = sorted(map(tuple, queries.QUERIES[name](spark, folder).select(*names).collect()), key=str)
    assert got == sorted(want.fetchall(), key=str)
    return got


def test_cases_of_other_agents_are_candidates(spark, folder):
    got = compared(spark, folder, "l18_similar_cases")
    assert [r[:2] for r in got] == [(0, 1), (0, 2), (0, 3)]


def test_cases_are_searched_by_classes(spark, monkeypatch):
    searched = []
    monkeypatch.setattr(nearest, "linear_top_k", lambda rows, asked, *a, found=nearest.linear_top_k, **k: searched.append((rows.count(), asked.count())) or found(rows, asked, *a, **k))
    case = "case_id long, blob string, agent_type string, task_type string, channel_type string, language string, artifact_ids array<string>, success boolean"
    c = spark.createDataFrame([(i, "do x", "a", "t", "c", "en", ["p"], True) for i in range(1, 40)] + [(i, "y", "a", "t", "c", "en", None, True) for i in (2, 2, 50)], case)
    r = c.where("case_id in (2, 3, 4)").distinct().selectExpr("case_id as request_id", "blob as query", "agent_type", "task_type", "channel_type", "language", "artifact_ids")
    got = {}
    for x in nearest.similar_cases(c, r.where("query = 'do x'"), 3).orderBy("request_id", "case_id").collect():
        got.setdefault(x["request_id"], []).append(x["case_id"])
    assert got == {2: [1, 3, 4], 3: [1, 2, 4], 4: [1, 2, 3]}
    assert searched == [(2, 1)]


@pytest.mark.parametrize("name", ["t06_cache_reuse", "k18_fetch_log"])
def test_requests_count_to_the_nearest_second(spark, folder, name):
    got = compared(spark, folder, name)
    if name == "t06_cache_reuse":
        assert got == [(0, 1, True), (1, 2, True), (2, 1, False), (3, 2, True)]
