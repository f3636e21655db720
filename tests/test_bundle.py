"""Lists of several stores under plans and policies."""

from lorewell.operators import bundle

HITS = "query_id long, store string, chunk_id string, source_type string, score double"
PLANS = "query_id long, use_internal boolean, use_graph boolean, use_episodic boolean, use_web boolean, allow_episodic boolean, allow_web boolean, allow_task boolean, allow_profile boolean, allow_reasoning boolean, mode string"


def test_lists_under_policies(spark):
    one = [("vector", "a", "document", 0.5), ("vector", "b", "episodic", 0.9), ("lexical", "a", "document", 0.5), ("episodic", "c", "episodic", 0.5), ("graph", "g", "graph", None), ("web", "w1", "web", 0.8), ("web", "w2", "web", 0.7), ("web", "w3", "web", 0.6), ("task", "t", "task", 0.95), ("reasoning", "r", "reasoning", 0.1), ("other", "o", "document", 9.0)]
    none = None
    plans = [(1, True, True, True, True, *[none] * 6), (2, True, False, True, True, False, False, none, none, none, none), (3, True, False, none, none, False, none, True, none, False, "task_memory"), (4, False, False, False, True, *[none] * 6)]
    hits = spark.createDataFrame([(q, *h) for q in (1, 2, 3, 9) for h in one], HITS)
    plans = spark.createDataFrame(plans, PLANS)
    chunks = bundle.bundled(bundle.admitted(hits, plans), 7)
    got = {}
    for r in chunks.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    # The third web hit had its place among the seven, and nothing takes it.
    assert got == {1: ["b", "w1", "w2", "a", "c", "g"], 2: ["a"], 3: ["t", "a"]}
    assert chunks.where("chunk_id = 'w1'").first().ranking_reason == "source=web;score=0.8"
    said = {r.query_id: (r.considered, r.allowed, r.used, r.reason) for r in bundle.augmentation(chunks, plans).collect()}
    assert said == {1: (True, True, True, bundle.USED), 2: (True, False, False, bundle.BLOCKED), 3: (False, False, False, bundle.NOT_ASKED), 4: (True, True, False, bundle.NOTHING)}
    assert bundle.bundled(bundle.admitted(hits.limit(0), plans), 7).count() == 0
