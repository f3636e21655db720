"""The web-fact state machine on hand-built facts, its stream against its batch, and contradictions against all pairs."""

import random
import tempfile

import pytest
from pyspark.sql import Row

from lorewell.operators import webfacts
from lorewell.operators.webfacts import Fact, claim_classes, latest, stepped, transitions, with_conflicts
from lorewell.streaming.facts import FactProcessor, transitions_of_files

H = 3600
BLANK = {"seq": 0, "evidence": None, "confidence": None, "has_source": None, "approved": None, "ttl_hours": None, "state": None, "tier": None, "lifecycle": None, "reason": None, "conflict": False}
EVENTS = "fact_id long, at long, seq long, op string, evidence array<string>, confidence double, has_source boolean, approved boolean, ttl_hours double, state string, tier string, lifecycle string, reason string, conflict boolean"


def fold(*events):
    fact = None
    for e in events:
        fact = stepped(fact, BLANK | e)
    return fact


def trusted(**more):
    return {"op": "upsert", "at": 0, "state": "trusted", "evidence": ["ev1", "ev2"], "confidence": 0.8, "has_source": True} | more


def test_fresh_until_exactly_the_ttl():
    assert fold(trusted(ttl_hours=72.0), {"op": "evaluate", "at": 47 * H}).freshness_reason == "within_ttl_window"
    at_bound = fold(trusted(ttl_hours=24.0), {"op": "evaluate", "at": 24 * H})
    assert (at_bound.lifecycle, at_bound.freshness_reason) == ("fresh", "within_ttl_window")
    beyond = fold(trusted(ttl_hours=24.0), {"op": "evaluate", "at": 24 * H + 1})
    assert (beyond.lifecycle, beyond.freshness_reason) == ("stale", "ttl_expired")
    assert fold(trusted(ttl_hours=24.0), {"op": "evaluate", "at": 48 * H}).lifecycle == "stale"
    assert fold(trusted(), {"op": "evaluate", "at": 72 * H}).lifecycle == "fresh"  # the default
    assert fold(trusted(ttl_hours=0.0), {"op": "evaluate", "at": 73 * H}).lifecycle == "stale"


def test_revalidation_keeps_the_first_request():
    f = fold(trusted(ttl_hours=24.0), {"op": "evaluate", "at": 48 * H}, {"op": "revalidate", "at": 48 * H + 60, "reason": "ttl_expired_requires_revalidation"}, {"op": "revalidate", "at": 50 * H})
    assert (f.lifecycle, f.asked_at, f.freshness_reason) == ("revalidation_pending", 48 * H + 60, "ttl_expired_requires_revalidation")
    again = stepped(f, BLANK | {"op": "promote", "at": 51 * H})
    assert (again.lifecycle, again.asked_at, again.validated_at) == ("fresh", None, 51 * H)


def test_stage_and_promotion():
    staged = {"op": "stage", "at": 5, "confidence": 0.7, "has_source": True, "evidence": ["a", "b"]}
    f = fold(staged)
    assert (f.state, f.tier, f.lifecycle, f.asked_at, f.validated_at, f.approval_reason) == ("staged", "local", "stale", 5, None, "staged_pending_approval")
    assert fold(staged, {"op": "promote", "at": 9}).state == "trusted"
    for short in ({"evidence": ["a", " a ", ""]}, {"confidence": 0.69}, {"has_source": False}):
        f = fold(staged | short, {"op": "promote", "at": 9})
        assert (f.state, f.lifecycle, f.approval_reason, f.asked_at) == ("staged", "stale", "insufficient_evidence_or_confidence", 5)
        assert fold(staged | short | {"approved": True}, {"op": "promote", "at": 9}).approval_reason == "explicit_backend_approval"
    assert fold({"op": "promote", "at": 1}) is None and fold(staged, {"op": "?", "at": 6}) == fold(staged)
    odd = fold(trusted(state="odd", tier="everywhere", lifecycle="ripe"))
    assert (odd.state, odd.tier, odd.lifecycle, odd.approved_at) == ("staged", "local", "stale", None)


def test_scopes():
    wide = fold(trusted(), {"op": "global", "at": 1}, {"op": "workspace", "at": 2}, {"op": "workspace", "at": 3}, {"op": "global", "at": 4})
    assert wide.tier == "global" and [m[:2] for m in wide.moves] == [["local", "workspace"], ["workspace", "global"]]
    assert fold(trusted(), {"op": "workspace", "at": 2, "conflict": True}).tier == "local"
    assert fold(trusted(confidence=0.59), {"op": "workspace", "at": 2}).tier == "local"
    for hindered in (trusted(confidence=0.79), trusted(evidence=["one"]), trusted(state="staged"), trusted(lifecycle="stale")):
        assert fold(hindered, {"op": "workspace", "at": 2}, {"op": "global", "at": 4}).tier == "workspace"
    assert fold(trusted(tier="workspace"), {"op": "global", "at": 4}).tier == "global"


def test_missing_basis_and_packing():
    f = Fact(created_at=None, state="trusted")
    assert stepped(f, BLANK | {"op": "evaluate", "at": 10}).freshness_reason == "missing_validation_basis"
    assert Fact.unpacked(f.packed()) == f


def log(seed=1, facts=60):
    rng = random.Random(seed)
    rows = []
    for i in range(facts):
        at = rng.randrange(1, 10) * H
        for n in range(rng.randint(0, 9)):
            op = "stage" if n == 0 and i % 9 else rng.choice(["upsert", "promote", "workspace", "global", "evaluate", "revalidate", "stage", "odd"])
            rows.append((i, at, n, op, rng.choice([None, [], ["a"], ["a", "b"], ["a", "a "]]), rng.choice([None, 0.5, 0.65, 0.75, 0.9]), rng.random() < 0.8, rng.random() < 0.3, rng.choice([None, 0.0, 5.0, 24.0]), rng.choice(["trusted", "staged", None]), rng.choice(["local", "workspace", None]), rng.choice([None, "fresh", "stale"]), None, rng.random() < 0.2))
            at += rng.randrange(1, 30) * H
    return rows


def test_stream_equals_batch(spark):
    rows = sorted(log(), key=lambda r: (r[1], r[2]))
    rows.append((9999, 1000 * H, 0, "stage", None, None, None, None, None, None, None, None, None, None))
    folder = tempfile.mkdtemp(prefix="spark-")
    size = -(-len(rows) // 5)
    for k in range(5):  # each file holds a later stretch of time
        spark.createDataFrame(rows[k * size : (k + 1) * size], EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events")
    got = transitions_of_files(spark, f"{folder}/events", f"{folder}/out", f"{folder}/state")
    want = transitions(spark.createDataFrame(rows, EVENTS), expire_until=1000 * H - 1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert want.where("op = 'expire'").count() > 5


class Counted:
    """A handle and its one state, which note what they are asked for; timers are not to be listed."""

    def __init__(self):
        self.calls, self.held, self.timers = [], None, set()

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


def test_the_stream_asks_its_state_seldom():
    state, processor = Counted(), FactProcessor()
    processor.init(state)

    def given(*events):
        state.calls = []
        rows = [Row(**(BLANK | e)) for e in events]
        return state.calls, list(processor.handleInputRows((7,), iter(rows), None))

    calls, out = given({"op": "evaluate", "at": 9, "seq": 1}, trusted(ttl_hours=1.0))
    assert calls == ["get", "update", "register"] and [r.op for r in out] == ["upsert", "evaluate"]
    assert state.timers == {(H + 1) * 1000}
    assert given({"op": "evaluate", "at": 20, "seq": 2})[0] == ["get"]  # still fresh: nothing is written
    assert given({"op": "promote", "at": 30, "seq": 3})[0] == ["get", "update", "delete", "register"]
    assert state.timers == {(30 + H + 1) * 1000}


def test_batch_equals_a_plain_fold(spark):
    rows = log(2, 200)
    table = spark.createDataFrame([*rows, (None, 1, 1, "stage", *[None] * 10)], EVENTS).repartition(5)
    got = {r.fact_id: r for r in latest(transitions(table)).collect()}
    facts = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        facts[r[0]] = stepped(facts.get(r[0]), dict(zip(webfacts.EVENT_COLUMNS, r)))
    facts = {i: f for i, f in facts.items() if f}
    assert got.keys() == facts.keys()
    for i, f in facts.items():
        assert (got[i].state, got[i].tier, got[i].lifecycle, got[i].validated_at, got[i].asked_at, got[i].n_moves) == (f.state, f.tier, f.lifecycle, f.validated_at, f.asked_at, len(f.moves))
    assert transitions(table.limit(0)).count() == 0


def test_facts_go_on_over_slices(spark, monkeypatch):
    table = spark.createDataFrame(log(3, 100), EVENTS).repartition(3)
    want = sorted(map(tuple, transitions(table, expire_until=1000 * H).collect()), key=str)
    monkeypatch.setattr(webfacts, "AT_ONCE", 3)
    assert sorted(map(tuple, transitions(table, expire_until=1000 * H).collect()), key=str) == want and want


@pytest.mark.parametrize("least", [1, 1000])
def test_conflicts_equal_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(webfacts, "join_by_share", lambda *a, **k: __import__("lorewell.operators.skew", fromlist=["x"]).join_by_share(*a, **k, least=least))
    rng = random.Random(7)
    claims = [(i, rng.choice(["Hot  Key", "hot key", "k1", "k2", "k3", "", None]), rng.choice(["A", " a ", "b", "c", None]), rng.randrange(1000)) for i in range(120)]
    table = spark.createDataFrame(claims, "fact_id long, claim_key string, claim_value string, at long")
    norm = [(i, " ".join((k or "").lower().split()), " ".join((v or "").lower().split()), t) for i, k, v, t in claims]
    norm = [c for c in norm if c[1] and c[2]]
    for r in claim_classes(table).collect():
        own = [c for c in norm if c[1:3] == (r.claim_key, r.claim_value)]
        others = [c for c in norm if c[1] == r.claim_key and c[2] != r.claim_value]
        assert (r.n_facts, r.first_fact, r.n_conflicting) == (len(own), min(c[0] for c in own), len(others))
        assert r.conflict_from == (max(min(c[3] for c in own), min(c[3] for c in others)) if others else None)
    events = table.selectExpr("*", "'stage' as op").unionByName(table.selectExpr("fact_id", "claim_key", "claim_value", "cast(500 as long) as at", "'workspace' as op"))
    for r in with_conflicts(events).collect():
        own = [c for c in norm if c[0] == r.fact_id]
        since = [max(c[3], o[3]) for c in own for o in norm if o[1] == c[1] and o[2] != c[2]]
        assert r.conflict == bool(since and min(since) <= r["at"]), r
