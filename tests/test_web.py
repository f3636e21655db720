"""Cache reuse, the fetch log and the order of web hits."""

import tempfile

from lorewell.operators import web


def requests(spark):
    rows = [(1, "q", 10, False, ["q"]), (2, "q", 10, True, ["q", "q latest"]), (3, "q", 30, True, ["q"]), (4, "other", 99, False, ["other"]), (5, None, 99, False, ["x"]), (6, "q", 5, None, ["q"])]
    return spark.createDataFrame(rows, "request_id long, query string, at long, sensitive boolean, variants array<string>")


def evidence(spark):
    return spark.createDataFrame([("q", 7, 10), ("q", 8, 20), ("q", 9, 25), ("q", 1, None), (None, 2, 1)], "query string, evidence_id long, fetched_at long")


def test_only_what_was_fetched_by_then_counts(spark):
    assert {r.request_id: r.cached for r in web.cached_at(requests(spark), evidence(spark), 2).collect()} == {1: 1, 2: 1, 3: 2, 4: 0, 5: 0, 6: 0}
    assert web.cached_at(requests(spark).limit(0), evidence(spark)).count() == 0 and web.cached_at(requests(spark), evidence(spark).limit(0)).count() == 6


def test_log_and_replayed_batches(spark):
    outcomes = spark.createDataFrame([(2, "q latest", 3, None), (4, "other", 9, "timeout")], "request_id long, query_variant string, n_results long, error string")
    log = web.fetch_log(requests(spark), evidence(spark), outcomes)
    got = {(r.request_id, r.query_variant): (r.status, r.http_status, r.result_count) for r in log.collect()}
    assert got == {(1, "q"): ("cache_hit", None, 1), (3, "q"): ("cache_hit", None, 3), (2, "q"): ("ok", 200, 0), (2, "q latest"): ("ok", 200, 3), (4, "other"): ("error", None, 0), (5, "x"): ("ok", 200, 0), (6, "q"): ("ok", 200, 0)}
    path = tempfile.mkdtemp(prefix="spark-") + "/log"
    for number in (0, 1, 1, 0):  # batches come again after a failure
        web.appended(log.where("request_id % 2 = 1") if number else log.where("request_id % 2 = 0"), number, path)
    kept = spark.read.parquet(path)
    assert kept.count() == log.count() and [r.batch for r in web.recent(kept, 3).collect()] == [1, 1, 1]


def test_order_of_web_hits(spark):
    facts = spark.createDataFrame([(1, 1, "staged", "global", "stale", False, 0.9), (1, 2, "trusted", "global", "fresh", True, 0.9), (1, 3, "trusted", "global", "fresh", False, 0.5), (1, 4, "trusted", "local", "fresh", False, 0.99)], "query_id long, fact_id long, state string, tier string, lifecycle string, contradicted boolean, confidence double")
    more = spark.createDataFrame([(1, 5, 0.9, None), (1, 6, 0.0, "s")], "query_id long, evidence_id long, trust double, source_id string")
    got = web.web_hits(facts, more, 6).orderBy("place").collect()
    assert [r.id for r in got] == ["webpromoted:3", "webpromoted:2", "webpromoted:1", "webpromoted:4", "webevidence:5", "webevidence:6"]
    assert [round(r.trust_score, 3) for r in got] == [0.64, 0.92, 0.91, 1.0, 0.9, 0.5] and got[1].contradiction_risk == 0.65 and got[4].cluster_id == "web"
