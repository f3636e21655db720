"""Discovery on hand-made pools, the category graph, and walks and expansion of session items."""

from pyspark.sql import functions as F

from lorewell.operators import discovery, graphs, recall
from lorewell.operators.discovery import Limits, Probe, conflicts, explore, helper_probes, probes_for


def hit(i, lane, text, risk=0.0, cluster=None, **more):
    return {"id": i, "lane": lane, "text": text, "contradiction_risk": risk, "cluster_id": cluster, "tokens": max(1, (len(text) + 3) // 4)} | more


POOL = [
    hit("a", "semantic", "Migration works with staged rollout and rollback plan", cluster="m1"),
    hit("b", "episodic", "Migration does not work without rollback checks", 0.6, "m1"),
    hit("c", "corpus", "Checklist includes rollback rehearsals and incident drills", cluster="m2"),
    hit("d", "corpus", "Unrelated gardening note for tomatoes", cluster="x1"),
]
PROBES = [Probe("skeptic", "Find conflicting migration evidence", ("semantic", "episodic")), Probe("domain specialist", "Find novel migration signals", ("corpus", "semantic"))]


def test_probes_look_into_their_lanes_and_contradictions_are_told():
    rows = explore(POOL, PROBES, Limits(branches=2, evidence=2, budget=80, injected=2))
    assert [r["evidence"] for r in rows] == [["branch-01:b", "branch-01:a"], ["branch-02:d", "branch-02:c"]]
    # b: 1 of 4 words, all new, no hedge, risk .6, new cluster; a as b without the risk
    assert rows[0]["score"] == round((round(0.35 / 4 + 0.3 + 0.06 + 0.1, 6) + round(0.35 / 4 + 0.3 + 0.1, 6)) / 2, 6)
    assert rows[0]["contradictions"] == ["branch-01:b|branch-01:a|0.5"] and rows[0]["used_tokens"] <= 80
    assert sum(len(r["injected"]) for r in rows) <= 2 and all(r["status"] == "explored" for r in rows)
    assert explore(POOL, [Probe("x", "nothing", ("web",))], Limits())[0]["unresolved"] == discovery.UNRESOLVED


def test_flag_contradiction():
    texts = ("Feature flag is enabled in production for all users", "Feature flag is not enabled in production for all users")
    assert conflicts([(str(i), set(discovery.terms(t))) for i, t in enumerate(texts)])[0][2] == 1.0


def test_helpers_and_roles():
    pool = [hit("a", "corpus", "x", cluster="k1", categories=[{"name": "db", "score": 0.9}], topics=[{"name": "t", "score": 0.05}]), hit("b", "corpus", "y", cluster="k1", categories=[{"name": "db", "score": 0.5}], topics=[])]
    got = helper_probes(pool, 4)
    assert [(p.source, p.strength, p.reason) for p in got] == [("category_graph", 0.9, "category:db"), ("clustering", 0.45, "cluster:k1"), ("topic_graph", 0.1, "topic:t")]
    assert [p.role for p in probes_for("planning", "q")] == ["ops reviewer", "architect", "security auditor"] and "(empty query)" in probes_for("?", " ")[0].prompt


def test_graph_is_merged_and_read_back(spark):
    words = {"db": ("schema", "index"), "ops": ("outage",)}
    hits = spark.createDataFrame([("corpus:1", "corpus", "corpus_chunk", "Schema and index and OUTAGE"), ("corpus:2", "corpus", "corpus_chunk", None), ("m:1", "episodic", "episodic_raw", "schema")], "id string, lane string, memory_type string, text string")
    first, old = graphs.annotated(hits, words, {}, now=F.lit(1).cast("long"))
    again, edges = graphs.annotated(hits, words, {"t": ("and",)}, old, F.lit(5).cast("long"))
    got = {r.id: r for r in again.collect()}
    assert [(c["name"], c["score"]) for c in got["corpus:1"].categories] == [("db", 0.7), ("ops", 0.5)] and [t["name"] for t in got["corpus:1"].topics] == ["t"]
    assert got["m:1"].categories == [] and got["corpus:2"].cluster_id.startswith("cl:")
    assert sorted((e.name, e.created_at, e.updated_at) for e in edges.collect()) == [("db", 1, 5), ("ops", 1, 5), ("t", 5, 5)]
    assert {r.id: r.cluster_id for r in first.collect()}["corpus:1"] != got["corpus:1"].cluster_id


def test_walk_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r"), ("c", "c", "r"), ("b", "d", "s"), (None, "d", "r")], "from_id string, to_id string, relation string")
    starts = spark.createDataFrame([("a",), ("d",), (None,), ("a",)], "start_id string")
    assert sorted(map(tuple, recall.walk(edges, starts).collect())) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("d", "d", 0)]
    assert sorted(map(tuple, recall.walk(edges, starts, ("r",), 1).collect())) == [("a", "a", 0), ("a", "b", 1), ("d", "d", 0)]


def test_upserts_keep_the_first_session(spark):
    log = spark.createDataFrame([("n1", "s1", "old", 1), ("n1", "s2", "new", 2), ("n2", "s9", None, 1)], "node_id string, session_id string, text string, at int")
    assert sorted(map(tuple, recall.upserted(log, ["node_id"], ["at"], ["session_id"]).select("node_id", "session_id", "text").collect())) == [("n1", "s1", "new"), ("n2", "s9", None)]
