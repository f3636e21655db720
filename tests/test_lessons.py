"""Discovery plans, tuning, lessons and topics, against hand-made cases and plain loops."""

import hashlib
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from lorewell.operators import controller, lessons, topics, tuning
from lorewell.plans import queries

ASKED = "query_id long, query string, hinted_intent string, local_evidence_count long, available_lanes array<string>"


def plans(spark, rows, **how):
    return {r.query_id: r for r in controller.discovery_plans(spark.createDataFrame(rows, ASKED), **how).collect()}


def test_plans_by_intent(spark):
    got = plans(
        spark,
        [
            (1, "Help me figure out what else matters for this migration risk", None, 0, None),
            (2, "How is your memory organized and where did this answer come from?", None, 0, None),
            (3, "What are the latest updates today and can you verify with sources?", None, 1, None),
            (4, "What is the current task state and blockers in this session?", None, 0, None),
            (5, None, "planning", None, None),
            (6, " Tabs\tand   more tabs; Alpha-beta and short and gamma-delta words! ", "nonsense", 0, ["web", "corpus"]),
            (7, "legal audit", "", 5, ["none"]),
            (7, "legal audit", "", 5, ["none"]),
        ],
    )
    assert got[1].intent_family == "investigative" and got[1].discovery_mode == "active" and len(got[1].expected_lanes) == 6 and not got[1].web_sensitive
    assert got[2].intent_family == "architecture_explanation" and got[2].discovery_mode == "off" and not [p for p in got[2].probes if p.kind == "novelty"]
    assert got[3].web_sensitive and got[3].expected_lanes[-1] == "web" and got[3].discovery_mode == "active" and got[3].risk_mode == "elevated"
    assert [p.role for p in got[3].probes if p.kind == "contradiction"] == ["skeptic", "compliance reviewer"]
    assert got[4].intent_family == "planning" and got[4].expected_lanes[:2] == ["episodic", "lexical"] and got[4].discovery_mode == "off"
    assert (got[5].intent_family, got[5].query, got[5].query_variants, got[5].adjacent_topics) == ("planning", "", [], [])
    assert got[5].probes[0].prompt == "[ops reviewer] Generate a bounded retrieval probe from this role perspective. Query: (empty query). Target lanes: episodic, lexical, promoted, semantic."
    assert got[6].query == "Tabs and more tabs; Alpha-beta and short and gamma-delta words!" and got[6].expected_lanes == ["corpus"]
    assert got[6].query_variants == [got[6].query, "tabs and more tabs alpha beta and short and gamma delta words", "more tabs alpha beta", "gamma delta words"]
    assert got[6].adjacent_topics == ["tabs", "more", "alpha", "beta", "short", "gamma"] and got[6].notes[-1] == "intent hint considered"
    assert got[7].risk_mode == "high" and got[7].discovery_mode == "passive" and len(got[7].expected_lanes) == 6 and len(got[7].notes) == 2
    mock = plans(spark, [(1, "", None, 9, None), (2, "roadmap", None, 0, None)], mock=True)
    assert mock[1].query_variants == ["(empty query)", "mock:investigative"] and mock[1].discovery_mode == "passive" and mock[1].risk_mode == "mock"
    assert [p.role for p in mock[2].probes] == ["ops reviewer", "architect"] and mock[2].discovery_mode == "off"
    assert not plans(spark, [])


def test_proposals_never_act(spark):
    runs = [(["b", "a"], None, {"recall": 0.5, "ms": 20.0}, " base "), (["a", "b"], [], {"ms": 20.0, "recall": 0.5}, "base"), (None, None, None, None)]
    runs = tuning.evaluation_runs(spark.createDataFrame(runs, "scenario_ids array<string>, artifact_refs array<string>, metrics_before map<string,double>, summary string"))
    ids = {r.summary: r.run_id for r in runs.collect()}
    line = json.dumps({"scenario_ids": ["a", "b"], "artifact_refs": [], "metrics_before": {"recall": 0.5, "ms": 20.0}, "summary": "base"}, sort_keys=True, separators=(",", ":"))
    assert ids.keys() == {"base", ""} and ids["base"] == "evalrun:" + hashlib.sha1(line.encode()).hexdigest()[:20]
    asked = [(ids["base"], {"k": "9"}, {"recall": 0.75, "cost": 1.0}, "more"), (ids["base"], {"k": "9"}, {"cost": 1.0, "recall": 0.75}, "more"), ("evalrun:none", None, None, None), (ids[""], None, None, None)]
    made = tuning.proposals(spark.createDataFrame(asked, "run_id string, candidate_patch map<string,string>, metrics_after map<string,double>, rationale string"), runs)
    rows = {r.run_id: r for r in made.collect()}
    assert len(rows) == 3 and rows[ids["base"]].delta == {"cost": 1.0, "ms": -20.0, "recall": 0.25} and rows[ids[""]].delta == {}
    assert rows["evalrun:none"].error == "unknown evaluation run_id: evalrun:none" and rows["evalrun:none"].proposal_id is None
    assert all(r.authoritative is False and r.status == "draft" and r.reason == "proposal_not_applied" for r in rows.values() if not r.error)
    p = rows[ids["base"]].proposal_id
    said = spark.createDataFrame([(p, 1, "early"), (p, 2, " "), ("tuneprop:none", 1, "x")], "proposal_id string, at long, reason string")
    after = {r.run_id: r for r in tuning.rejected(made, said).collect()}
    assert (after[ids["base"]].status, after[ids["base"]].reason, after[ids[""]].status) == ("rejected", "rejected", "draft") and len(after) == 3
    assert [r.proposal_id for r in tuning.unknown_rejections(made, said).collect()] == ["tuneprop:none"]
    policy = tuning.effective_policy(made).first()
    assert policy.source == "baseline" and policy.applied_proposal_id is None and policy.policy["retrieval_ranking"] == "default"
    assert tuning.effective_policy(made.limit(0)).first().source == "baseline"


CASES = "case_id long, agent_type string, task_type string, channel_type string, success boolean, artifact_ids array<string>, request_text string, output_text string, created_at long"
REQUESTS = "request_id long, agent_type string, task_type string, channel_type string, language string"


def test_lessons_of_the_newest_cases(spark):
    rng = random.Random(3)
    pick = lambda *xs: rng.choice((*xs, None, ""))
    rows = [(i, pick("a", "b"), pick("t"), pick("c", "d"), rng.choice((True, False, None)), rng.choice((None, [], list("vwxyz"))), rng.choice((None, " ask " * 80)), "out", rng.choice((None, i % 7))) for i in range(200)]
    asked = [(1, "a", None, "", None), (2, None, None, None, None), (3, "b", "t", "d", None), (4, "nobody", None, None, None), (1, "a", None, "", None)]
    made = lessons.execution_lessons(spark.createDataFrame(rows, CASES), spark.createDataFrame(asked, REQUESTS), 6)
    got = Counter((r.request_id, r.case_id) for r in made.collect())
    want = Counter()
    for rid, *keys, _ in set(asked):
        fit = [r for r in rows if all(not k or k == v for k, v in zip(keys, r[1:4]))]
        want.update((rid, r[0]) for r in sorted(fit, key=lambda r: (r[8] is None, -(r[8] or 0), r[0]))[:6])
    assert got == want
    by_id = {r[0]: r for r in rows}
    for r in made.collect():
        c = by_id[r.case_id]
        assert r.text.startswith(f"Execution lesson: For {c[2] or ''}, a {'' if c[4] else 'un'}successful run used artifacts {', '.join((c[5] or [])[:4]) or 'none'}; request='{(c[6] or '').strip()[:160]}'; output='out'.")
        assert r.confidence == (0.85 if c[4] else 0.65) and r.namespace == "craft_execution_lessons"
    assert lessons.execution_lessons(spark.createDataFrame([], CASES), spark.createDataFrame(asked, REQUESTS)).count() == 0
    assert lessons.execution_lessons(spark.createDataFrame(rows, CASES), spark.createDataFrame([], REQUESTS)).count() == 0


def test_evaluations_to_follow_and_to_avoid(spark):
    schema = "evaluation_id long, execution_id long, agent_type string, task_type string, channel_type string, language string, overall double, passed boolean, strengths array<string>, weaknesses array<string>, improvements array<string>, anti_patterns array<string>, edits string, created_at long"
    rows = [(1, 7, "a", "t", "c", "en", 0.9, True, ["Clear hook"], None, None, [], "cut it", 1), (2, 7, "a", "t", "c", "en", 0.4, False, None, ["slow"], None, ["x", "y", "z", "w"], None, 2), (3, 8, "a", "t", "c", "fr", 0.9, True, None, None, None, None, None, 3), (4, None, "b", "t", "c", "fr", None, None, None, None, None, None, None, None)]
    rows = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame([(1, "a", "", None, None), (2, "a", None, None, "en")], REQUESTS)
    assert [(r.request_id, r.evaluation_id, r.score) for r in lessons.ranked_evaluations(rows, asked).orderBy("request_id", "evaluation_id").collect()] == [(1, 1, 12.0), (1, 3, 12.0), (2, 1, 12.0)]
    weak = lessons.ranked_evaluations(rows, asked, weak=True).collect()
    assert {(r.request_id, r.evaluation_id, r.score, tuple(r.reasons)) for r in weak} == {(i, 2, 14.0, ("failed_case", "anti_pattern_hits")) for i in (1, 2)}
    of = spark.createDataFrame([(1, 7, "CLEAR, slow"), (2, 9, "x")], "request_id long, execution_id long, query string")
    found = {r.evaluation_id: (r.score, r.reasons) for r in lessons.evaluations_of_executions(rows, of).collect()}
    assert found == {1: (15.0, ["passed_case", "text_match"]), 2: (17.0, ["failed_case", "anti_pattern_hits", "text_match"])}
    made = {r.case_id: r.text for r in lessons.evaluation_lessons(rows, asked.where("request_id = 2")).collect()}
    assert made[2] == "Evaluation lesson: score=0.40, pass=False; weaknesses=slow; improvements=none; anti_patterns=x, y, z."


def test_topics_of_planted_mixtures(spark):
    """Four vocabularies and a common one; nulls, empty and strange texts are outliers."""
    rng = random.Random(1)
    themes = [[f"{name}{i}" for i in range(40)] for name in ("river", "engine", "violin", "pastry")]
    common, rows = [f"common{i}" for i in range(10)], []
    for i in range(400):
        words = rng.choices(themes[i % 4], k=30) + rng.choices(common, k=15) + rng.choices(themes[rng.randrange(4)], k=3)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (902, "unheard of"), (0, rows[0][1])], "doc_id long, text string")
    found = topics.fit_topics(docs, 4)
    placed = topics.place_documents(docs, found)
    got = [(r.doc_id, r.topic) for r in placed.collect()]
    assert len(got) == 404 and all(t == -1 for i, t in got if i >= 900)
    most = {t: Counter(i % 4 for i, x in got if i < 400 and x == t).most_common(1)[0][1] for t in range(4) if any(x == t for _, x in got)}
    assert sum(most.values()) >= 0.95 * 401 and len(most) == 4  # purity
    nodes, edges = topics.topic_graph(docs, placed, found)
    kinds = Counter(r.node_type for r in nodes.collect())
    assert kinds == {"document": 404, "topic": 4} and edges.count() == sum(t >= 0 for _, t in got)
    assert {r.label[:5] for r in nodes.where("node_type = 'topic'").collect()} <= {"river", "engin", "violi", "pastr", "commo"}
    assert edges.where("weight < 0.3").count() == 0


def test_no_words_no_topics(spark):
    docs = spark.createDataFrame([(1, None), (2, "alone")], "doc_id long, text string")
    for d in (docs, docs.limit(0)):
        found = topics.fit_topics(d, 3)
        nodes, edges = topics.topic_graph(d, topics.place_documents(d, found), found)
        assert edges.count() == 0 and nodes.count() == d.count()


def test_cases_are_cut_before_they_are_dealt_to_patterns(spark):
    rows = [(i, f"a{i % 3}", None if i % 4 else "t", i) for i in range(60)]
    cases = spark.createDataFrame(rows, "case_id long, agent_type string, task_type string, at long")
    asked = spark.createDataFrame([(1, "a1", None), (2, None, "t"), (3, "", ""), (4, "a2", "t")], "request_id long, agent_type string, task_type string")
    found = lessons.first_matching(cases, asked, ("agent_type", "task_type"), [F.col("at").desc(), F.col("case_id")], 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.rindex("WindowGroupLimit")
    got = {}
    for r in found.orderBy("request_id", F.col("case.at").desc()).select("request_id", "case.case_id").collect():
        got.setdefault(r[0], []).append(r[1])
    assert got == {1: [58, 55, 52, 49], 2: [56, 52, 48, 44], 3: [59, 58, 57, 56], 4: [56, 44, 32, 20]}


def test_topic_graph_places_documents_once(spark):
    found = queries.QUERIES["c16_topic_graph"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert found.where("label is null").count() == 0 and found.select("label").distinct().count() > 1
