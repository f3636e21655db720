"""The service surface end to end over a temporary folder."""

import pytest

from lorewell.plans.engine import MemoryEngine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    files = root / "files"
    files.mkdir()
    (files / "plan.md").write_text("# Rollout\nThe rollout plan keeps a rollback step ready.\n## Risks\nLocking of the index.\n")
    (files / "note.txt").write_text("Storage notes without a heading about caches.")
    e = MemoryEngine(spark, str(root / "tables"))
    rows = [("s1", f"m{i:02d}", i, "user" if i % 2 else "assistant", "ok" if i == 3 else f"Message {i} says that the rollout of stage {i} follows the plan closely.") for i in range(30)]
    e.upsert("messages", spark.createDataFrame(rows, "session_id string, message_id string, seq long, sender string, text string"))
    e.ingest(str(files))
    return e


def test_upserts_are_idempotent(spark, engine):
    again = spark.createDataFrame([("s1", "m00", 0, "user", "changed text of the first message, long enough")], "session_id string, message_id string, seq long, sender string, text string")
    assert engine.upsert("messages", again) == {"inserted": 0, "replaced": 1}
    assert engine.table("messages").count() == 30
    assert engine.session_log("s1").where("index = 0").first()["text"].startswith("changed")


def test_ingest_replaces_chunks(engine):
    titles = {r["title"] for r in engine.table("chunks").collect()}
    assert {"Rollout", "Risks", ""} <= titles
    assert "rollback" in engine.query("rollback step").first()["text"]


def test_compaction_promotion_and_recall(engine):
    made = engine.compact(tail=8, size=10)
    assert made == 4 and engine.compact(tail=8, size=10) == 0
    state = engine.compaction_state().first()
    assert (state["messages"], state["segments"], state["quarantined"]) == (30, 3, 1)
    lineage = [m for r in engine.table("segments").collect() for m in r["lineage"]]
    assert sorted(lineage) == [f"m{i:02d}" for i in range(22)]
    segment = engine.table("segments").where("not quarantined and chunk = 0").first()
    assert [r["message_id"] for r in engine.expand_segment(segment["segment_id"]).collect()] == segment["lineage"]
    assert engine.promote() > 0 and engine.promote() == 0
    found = engine.promoted_search("rollout plan").first()
    assert engine.promoted_get(found["pattern_id"]).count() == 1
    refs = [r["ref"].split(":")[0] for r in engine.recall("s1", "stage 2", 50).collect()]
    assert refs == sorted(refs, key=["message", "part", "segment"].index) and "segment" in refs


def test_parts_and_export(spark, engine):
    parts = [("s1", "m01", 0, 1, "tool_call", "run", "failed"), ("s1", "m01", 1, 2, None, "run again", "success")]
    engine.upsert("parts", spark.createDataFrame(parts, "session_id string, message_id string, part_index int, seq long, part_type string, text string, status string"))
    out = {r["message_id"]: r for r in engine.export("s1").collect()}
    assert [p["status"] for p in out["m01"]["parts"]] == ["failed", "success"] and out["m02"]["parts"] == []


def test_context_fits_the_budget(engine):
    got = engine.assemble_context("s1", "what does the rollout plan say", "planning", 500, 100).collect()
    chosen = [r for r in got if r["status"] == "selected"]
    assert chosen and sum(r["tokens"] for r in chosen) <= 400
    assert {"fresh_tail", "episodic"} <= {r["lane"] for r in chosen}
    assert all(r["reason"] for r in got if r["status"] == "dropped")
