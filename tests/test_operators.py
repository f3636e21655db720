"""Operators on small fixtures, against plain restatements and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from lorewell.functions import lexicons as lx
from lorewell.operators import chunk, discovery, fold, merge, rank, select
from lorewell.sources import tables

HIT = "query_id long, query string, ord long, id string, lane string, lane_index int, memory_type string, text string, tokens int, lexical_score double, semantic_score double, trust_score double, recency_score double, freshness_score double, novelty_score double, contradiction_risk double, cluster_id string, must_include boolean, compressible boolean, claim_key string, claim_value string, has_provenance boolean"


def hit(i, lane="lexical", text=None, query=1, **more):
    text = f"text number {i} about topic {i % 3}" if text is None else text
    base = dict(query_id=query, query="topic number", ord=i, id=f"h{i:03d}", lane=lane, lane_index=0, memory_type="message", text=text, tokens=select.estimate(text), lexical_score=0.5, semantic_score=0.4, trust_score=0.6, recency_score=0.1, freshness_score=0.2, novelty_score=0.3, contradiction_risk=0.0, cluster_id=None, must_include=False, compressible=False, claim_key=None, claim_value=None, has_provenance=True)
    return base | more


def table(spark, hits):
    return spark.createDataFrame([tuple(h[c.split()[0]] for c in HIT.split(", ")) for h in hits], HIT)


def plain_utility(h, chosen, intent):
    rel, prov, rec, fresh, nov, fit, red, con = lx.WEIGHTS[intent]
    words = set(h["text"].lower().split())
    over = max((len(words & set(o["text"].lower().split())) / len(words) for o in chosen if words), default=0.0)
    fits = 0.8 if h["lane"] in ("corpus", "large_file", "promoted", "episodic") else 0.45
    bonus = 0.2 if h["cluster_id"] and h["cluster_id"] not in {o["cluster_id"] for o in chosen} else 0.0
    return rel * (h["lexical_score"] + h["semantic_score"]) / 2 + prov + rec * h["recency_score"] + fresh * (h["freshness_score"] + h["trust_score"]) / 2 + nov * h["novelty_score"] + fit * fits - con * h["contradiction_risk"] - red * over + bonus


def plain_selection(hits, intent, budget, reserved):
    """The greedy choice with every utility computed anew in each round."""
    policy, chosen, used = select.Policy.of(intent), [], reserved
    left = [h for h in hits if h["contradiction_risk"] <= 0.95]

    def take(h):
        nonlocal used
        lane = sum(o["lane"] == h["lane"] for o in chosen)
        if used + h["tokens"] <= budget and lane < policy.maxima.get(h["lane"], 10**9):
            chosen.append(h)
            used += h["tokens"]

    def best(some):
        return min(some, key=lambda h: (-plain_utility(h, chosen, intent) / max(1, h["tokens"]), -plain_utility(h, chosen, intent), h["id"]))

    for h in sorted((h for h in left if h["must_include"]), key=lambda h: (h["tokens"], h["id"])):
        take(h)
    left = [h for h in left if h not in chosen]
    for lane, least in sorted(policy.minima.items()):
        while sum(o["lane"] == lane for o in chosen) < least and any(h["lane"] == lane for h in left):
            h = best([h for h in left if h["lane"] == lane])
            left.remove(h)
            take(h)
    while left:
        h = best(left)
        left.remove(h)
        take(h)
    return {h["id"] for h in chosen}


def test_selection_equals_a_plain_restatement(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    hits = []
    for q in range(6):
        for i in range(25):
            text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))
            hits.append(hit(i, rng.choice(["lexical", "corpus", "episodic", "fresh_tail", "promoted"]), text + f" u{i}", q, lexical_score=rng.random(), semantic_score=rng.random(), cluster_id=rng.choice([None, "a", "b"]), must_include=rng.random() < 0.1, contradiction_risk=rng.choice([0.0, 0.3, 0.99])))
    got = select.select_context(table(spark, hits), "investigative", 600, 100).collect()
    for q in range(6):
        own = [h for h in hits if h["query_id"] == q]
        chosen = [r for r in got if r["query_id"] == q and r["status"] == "selected"]
        assert {r["id"] for r in chosen} == plain_selection(own, "investigative", 600, 100)
        assert sum(r["tokens"] for r in chosen) + 100 <= 600
        assert sorted(r["place"] for r in chosen) == list(range(len(chosen)))
        assert {r["id"] for r in got if r["query_id"] == q} == {h["id"] for h in own}
    assert all(r["reason"] for r in got if r["status"] == "dropped")


def test_conflicting_claims_are_not_chosen_together(spark):
    hits = [hit(1, claim_key="k", claim_value="a", lexical_score=0.9), hit(2, claim_key="k", claim_value="b"), hit(3, text="the cache works with storage"), hit(4, text="the cache never fits storage")]
    got = {r["id"]: r for r in select.select_context(table(spark, hits), "planning").collect()}
    assert (got["h001"]["status"], got["h002"]["reason"]) == ("selected", "compatibility_conflict")
    assert {got["h003"]["status"], got["h004"]["status"]} == {"selected", "dropped"}


def test_pruning(spark):
    long = " ".join(["word"] * 700)
    out = select.pruned([hit(1, text=long, compressible=True), hit(2, text="tiny a", compressible=True), hit(3, text="tiny b", compressible=True), hit(4, text="tiny c", compressible=True), hit(5, "fresh_tail", "x", compressible=True), hit(6, "fresh_tail", "y", compressible=True)])
    assert " ".join(h["text"] for h in out if "#part" in h["id"] and "+" not in h["id"]).split() == ["word"] * 700 or any("+" in h["id"] for h in out)
    assert [h["id"] for h in out][-3:] == ["h002+h003+h004", "h005", "h006"] or out[-3]["id"].endswith("h002+h003+h004")
    assert all(select.estimate(t) >= 320 for t in select.split_words(long, 320)[:-1])
    assert " ".join(select.split_words(long, 320)) == long
    doubled = select.select_context(table(spark, [hit(1, text="Same  text"), hit(2, text="same text")]), "planning").collect()
    assert [r["id"] for r in doubled] == ["h001"]


def test_rerank(spark):
    strong = [hit(1, semantic_score=0.92, promotion=1, contradiction_risk=0.5), hit(2, semantic_score=0.74), hit(3, "corpus", lane_index=None, semantic_score=0.9)]
    weak = [hit(i, query=2, lexical_score=0.0, semantic_score=0.0, trust_score=0.0, lane_index=999, text="zzz") for i in (9, 8)]
    alone = [hit(5, query=3)]
    got = rank.rerank(table(spark, strong + weak + alone)).orderBy("query_id", "place").collect()
    order = {q: [r["id"] for r in got if r["query_id"] == q] for q in (1, 2, 3)}
    assert order[1] == ["h002", "h001", "h003"] or order[1][0] == "h002"
    assert order[2] == ["h008", "h009"] and not any(r["applied"] for r in got if r["query_id"] != 1)
    h = next(r for r in got if r["id"] == "h002")
    fit = 1.0
    assert h["final_score"] == pytest.approx(0.55 * (0.45 * 0.74 + 0.35 * 0.5 + 0.2 * 0.6) + 0.25 + 0.1 * fit, abs=1e-6)


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1, "first"), (2, "b", 1, "second")], "k long, v string, seq long, made string")
    new = spark.createDataFrame([(1, "z", 2, "later"), (3, "c", 1, "third"), (1, "y", 3, "latest")], "k long, v string, seq long, made string")
    got = {r["k"]: (r["v"], r["made"]) for r in merge.upsert(old, new, ["k"], ["seq"], ["made"]).collect()}
    assert got == {1: ("y", "first"), 2: ("b", "second"), 3: ("c", "third")}
    assert {r["v"] for r in merge.keep_latest(new, ["k"], ["seq"]).collect()} == {"y", "c"}
    assert sorted(r["v"] for r in merge.replace_children(old, new, "k").collect()) == ["b", "c", "y", "z"]
    assert merge.append_unique(old, new.where("k = 3"), ["k"]).count() == 3
    with pytest.raises(Exception, match="a key comes twice"):
        merge.append_unique(old, new, ["k"]).collect()


def test_only_texts_that_can_be_alike_are_compared(spark):
    lead = " ".join(f"a{n:02}" for n in range(24))  # one bucket
    texts = [lead, f"{lead} z", f"{lead} " + "zz " * 40, f"{lead} zy", f"{lead} " + "zz " * 39 + "zy", *(f"{lead} {'z' * n}" for n in range(5, 15))]
    patterns = fold.fold_exact(fold.fingerprints(spark.createDataFrame(list(enumerate(texts)), "id long, text string")))
    found = {r.pattern_id: r for r in fold.candidates(patterns).collect()}
    tried = {i: [h.pattern_id for h in found[i].tried or ()] for i in found}
    assert found[0].norm is None and found[2].norm is None and found[2].tried is None  # nothing goes to be compared
    assert tried[1] == [0] and tried[3] == [0, 1] and tried[4] == [2]
    norm = [" ".join(t.split()) for t in texts]
    want = {i: next((j for j in range(min(i, 4)) if fold.alike(norm[i], norm[j])), i) for i in range(len(texts))}
    assert {r.pattern_id: r.canonical_id for r in fold.link_near(patterns).collect()} == want


def test_folds(spark):
    base = "a workflow that reads the plan and then writes the summary for the reviewer to check"
    rows = [(1, base), (2, base.upper()), (3, base.replace("that reads the", "the that reads")), (4, "something else entirely"), (5, "")]
    got = fold.link_near(fold.fold_exact(fold.fingerprints(spark.createDataFrame(rows, "id long, text string")))).collect()
    assert {(r["pattern_id"], r["reuse_count"], r["canonical_id"]) for r in got} == {(1, 2, 1), (3, 1, 1 if fold.alike(base, rows[2][1]) else 3), (4, 1, 4), (5, 1, 5)}


def test_chunks(spark):
    md = "intro\n# One\ntext\n\n## Two\n" + "long line. " * 60
    code = "import x\n\ndef first():\n    pass\n\nclass Second:\n    pass\n"
    docs = spark.createDataFrame([("m", "md", md), ("c", "py", code), ("t", "txt", "abc " * 200), ("e", "txt", ""), ("n", None, None)], "document_id string, kind string, text string")
    got = chunk.chunk(docs, 180, 40).orderBy("document_id", "chunk_index").collect()
    titles = [r["title"] for r in got if r["document_id"] == "m"]
    assert titles[:3] == ["", "One", "Two"] and set(titles) == {"", "One", "Two"}
    assert [r["title"] for r in got if r["document_id"] == "c"] == ["", "first", "Second"]
    for r in got:
        whole = {"m": md, "c": code, "t": "abc " * 200}[r["document_id"]]
        assert whole[r["char_start"] : r["char_end"]] == r["text"] and len(r["text"]) <= 180
    plain = [r for r in got if r["document_id"] == "t"]
    assert all(a["overlap_after"] == b["overlap_before"] for a, b in zip(plain, plain[1:]))
    with pytest.raises(ValueError):
        list(chunk.windows("text", 10, 10))


def test_discovery_is_bounded(spark):
    pool = [hit(i, text=f"topic number fact{i} maybe", cluster_id=f"c{i}", tokens=100) for i in range(8)]
    got = discovery.discover(table(spark, pool)).collect()
    assert [r["branch_id"] for r in sorted(got, key=lambda r: r["branch_id"])] == ["branch-01", "branch-02", "branch-03"]
    assert all(r["evidence_count"] <= 3 and r["used_tokens"] <= 220 for r in got)
    assert sum(len(r["injected"]) for r in got) == 2
    assert discovery.curiosity([], frozenset(), set(), 0.0, None) == 0.0


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.md").write_text("# t\nhello")
    (tmp_path / "c.bin").write_text("no")
    (tmp_path / "raw_s1.json").write_text('[{"message_id":"m1","text":"x","sender":"user","created_at":"2026-01-01"},{"message_id":"m0","text":"y","index":7,"created_at":"2026-01-02"}]')
    got = {r["kind"]: r["document_id"] for r in tables.load_files(spark, str(tmp_path)).where(F.col("kind") != "json").collect()}
    assert set(got) == {"txt", "md"} and got["txt"].startswith("doc_2cf24dba5fb0a30e")
    log = {r["message_id"]: (r["session_id"], r["index"]) for r in tables.load_session_json(spark, f"{tmp_path}/raw_s1.json").collect()}
    assert log == {"m1": ("s1", 0), "m0": ("s1", 7)}


def test_episodic_lane_fills_up_with_older_messages(spark):
    from lorewell.operators import lanes

    texts = ["a", None, "b c", "", "c", "d", "e"]
    m = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "a")], "session_id long, message_id long, text string")
    q = spark.createDataFrame([(7, 1, "C x"), (8, 1, None), (9, 3, "a")], "query_id long, session_id long, query string")
    got = lanes.episodic_lane(q, m, tail=2, k=4).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["message_id"], r["lane"]) for r in got] == [(i, n, "fresh_tail" if n > 4 else "episodic") for i in (7, 8) for n in (5, 6, 4, 2)]
    assert [r["lexical_score"] for r in got] == [0.3, 0.3, 0.7, 0.7, 0.3, 0.3, 0.2, 0.2]
    assert [round(r["recency_score"], 6) for r in got[:4]] == [0.5, 1.0, round(1 - 1 / 6, 6), round(1 - 3 / 6, 6)]


def test_searches_of_all_rows_handle_nulls_ties_and_none(spark):
    from lorewell.operators import lanes, nearest

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.0]), (6, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    q = v.where("vec_id in (1, 4)").withColumnRenamed("vec_id", "query_id")
    assert [tuple(r) for r in nearest.nearest_vectors(v, q, 3, block=1).orderBy("score", "vec_id").collect()] == [(1, 3, 0.0), (1, 2, 1.0), (1, 5, 1.0)]
    assert nearest.nearest_vectors(v, q.limit(0), 3).count() == 0 and nearest.nearest_vectors(v.limit(0), q, 3).count() == 0
    d = spark.createDataFrame([(1, "b"), (2, None), (3, ""), (4, "A a"), (10, "x")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a z"), (2, None)], "query_id long, query string")
    got = sorted(tuple(r)[:2] + (r["lexical_score"],) for r in lanes.overlap_lane(asked, d, "d:", 2).collect())
    assert got == [(1, 1, 0.0), (1, 4, 0.5), (2, 1, 0.0), (2, 10, 0.0)]
    assert lanes.overlap_lane(asked, d.limit(0), "d:", 2).count() == 0
    case = "case_id long, blob string, agent_type string, task_type string, channel_type string, language string, artifact_ids array<string>, success boolean"
    c = spark.createDataFrame([(i, "do x", "a", None, "c", "en", ["p", "q"], i % 2 == 0) for i in range(1, 7)] + [(9, None, None, None, None, None, None, None)], case)
    r = spark.createDataFrame([(2, "x", "a", "t", "", None, ["p"])], "request_id long, query string, agent_type string, task_type string, channel_type string, language string, artifact_ids array<string>")
    assert [(x["case_id"], x["score"]) for x in nearest.similar_cases(c, r, 3).orderBy("score", "case_id", ascending=[False, True]).collect()] == [(4, 29.5), (6, 29.5), (1, 28.0)]


def test_distilled_notes(spark):
    from lorewell.operators import distil

    rows = [(1, "craft", "Use {Hook} and {body}. Example after: done!\nAvoid this -> now"), (2, "content", "Always a rule."), (3, None, "No cue here"), (4, "craft", None), (5, "craft", " \n "), (1, "craft", "Score: a; b")]
    found = distil.detailed(distil.distilled(spark.createDataFrame(rows, "ref long, source_kind string, text string"))).collect()
    kinds = sorted((r["ref"], r["artifact_type"], r["namespace"]) for r in found)
    assert kinds == [(1, "anti_pattern", "craft_antipatterns"), (1, "example", "craft_examples"), (1, "raw_chunk", "craft_raw"), (1, "raw_chunk", "craft_raw"), (1, "rubric", "craft_rubrics"), (1, "template", "craft_templates"), (2, "raw_chunk", "content_books_raw"), (3, "raw_chunk", "craft_raw")]
    by_type = {r["artifact_type"]: r for r in found}
    assert by_type["template"]["slots"] == ["hook"] and by_type["template"]["steps"] is None  # "{body}." ends with a stop
    assert by_type["rubric"]["criteria"] == ["Score: a", "b"] and by_type["rubric"]["scale"] == "unspecified"
    assert by_type["example"]["verdict"] == "good"


def test_promoted_summaries(spark):
    from lorewell.operators import promote

    rows = [(1, 0, "The user said that user prefers tea. Run the tests then ship"), (1, 1, "User prefers tea"), (1, 2, "For today only. Plain fact"), (2, 0, "Plain fact\nSecond"), (2, 1, None), (2, 2, "  ")]
    found = promote.promoted_patterns(spark.createDataFrame(rows, "session_id long, chunk_index long, text string")).collect()
    got = {(r["session_id"], r["canonical_text"]): (r["kind"], r["memory_subtype"], round(r["confidence"], 6), r["dedup_count"], r["sources"]) for r in found}
    assert got == {
        (1, "user prefers tea"): ("proposition", "profile_preference", 0.76, 2, [0, 1]),
        (1, "run the tests then ship"): ("prescription", "workflow_pattern", 0.85, 1, [0]),
        (2, "plain fact"): ("proposition", "stable_fact", 0.7, 1, [0]),
    }


def test_near_patterns_are_compared_with_the_whole_bucket(spark):
    """Against a loop over all earlier patterns of a bucket: the only alike one may have any place, in any cell."""
    random.seed(5)
    lead = " ".join(f"a{n:02}" for n in range(24))  # one bucket
    kinds = [" ".join("".join(random.sample("stuvwxyz", 5)) for _ in range(25)) for _ in range(9)]
    texts = [f"{lead} {random.choice(kinds)} {'z' * random.randrange(1, 9)}{n}" for n in range(60)] + [lead + " z" * n for n in range(30)] + ["", "other"]
    rows = [*enumerate(texts), (200, texts[50]), (201, texts[50]), (202, texts[7]), (300, None)]
    patterns = fold.fold_exact(fold.fingerprints(spark.createDataFrame(rows, "id long, text string"))).cache()
    held = sorted(patterns.collect(), key=lambda r: (-r.reuse_count, r.pattern_id))
    want = {r.pattern_id: next((h.pattern_id for h in held[:n] if h.near_fp == r.near_fp and fold.alike(r.norm, h.norm)), r.pattern_id) for n, r in enumerate(held)}
    places = {r.pattern_id: n for n, r in enumerate(held)}
    assert sum(places[want[i]] >= 4 and want[i] != i for i in want) > 10  # links beyond the best four
    for block in (7, 250):
        assert {r.pattern_id: r.canonical_id for r in fold.link_near(patterns, block).collect()} == want


def test_a_ratio_that_is_cut_short_is_decided_as_the_whole_one():
    from difflib import SequenceMatcher

    random.seed(7)
    seen = set()
    for n in range(400):
        a = "".join(random.choice("abc de") for _ in range(random.randrange(0, 400)))
        b = "".join(c for c in a if random.random() > random.choice((0.02, 0.07, 0.2))) + "x" * (n % 9)
        m = SequenceMatcher(None, a, b)
        assert fold.reaches(m) == (m.ratio() >= fold.RATIO)
        seen.add(fold.reaches(m))
    assert seen == {True, False}
