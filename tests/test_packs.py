"""Skill packs against a plain loop over ranked artifacts."""

import random

from lorewell.operators import packs
from lorewell.operators.nearest import ARTIFACT_MATCH, rank_artifacts

TYPES = [*packs.TYPE_ORDER, "style_gist"]


def plain(ranked, adjust, most):
    """ranked: (artifact_id, type, score) of one request."""
    rows = sorted(((round(s + adjust.get(a, 0.0), 6), a, t) for a, t, s in ranked), key=lambda r: (-r[0], r[1]))
    chosen, typed = [], 0
    for kind in packs.TYPE_ORDER:
        taken = 0
        for s, a, t in rows:
            if t == kind and taken < packs.QUOTAS[kind] and len(chosen) < most and not (kind == packs.RAW and typed >= packs.ENOUGH_TYPED):
                chosen.append((a, s))
                taken += 1
                typed += kind != packs.RAW
    return chosen


def net(u, r, c, s):
    if u + r + c < 2:
        return 0.0
    return max(-4.5, min(5.0, min(5.0, r * 1.6 + u * 0.4 + min(1.0, s * 0.2)) - min(4.5, c * 1.5)))


def test_packs_equal_a_plain_loop(spark):
    rng = random.Random(5)
    words = ["hook", "cta", "pace", "tone", "cut", "draft"]
    arts = [(i, rng.choice(TYPES if i % 3 else ["raw_chunk"]), rng.random(), " ".join(rng.choices(words, k=5))) for i in range(90)]
    signals = [(i, *(rng.randrange(4) for _ in range(4))) for i in range(0, 90, 2)]
    says = {k: None for k in ARTIFACT_MATCH} | {"agent_type": "hook_cta"}
    for rows in (arts, arts[:5], [a for a in arts if a[1] == "raw_chunk"]):
        a = spark.createDataFrame(rows, "artifact_id long, artifact_type string, confidence double, blob string")
        q = spark.createDataFrame([(1, "hook pace", *says.values()), (2, "", *says.values())], "request_id long, query string, " + ", ".join(f"{k} string" for k in says))
        s = spark.createDataFrame(signals, "artifact_id long, uses long, reinforces long, critiques long, supports long")
        ranked = rank_artifacts(a, q, 1000).collect()
        kinds = {r[0]: r[1] for r in rows}
        for most in (3, 12, 40):
            found = packs.skill_packs(a, q, s, most)
            got = found.orderBy("request_id", "place").collect()
            for request in (1, 2):
                want = plain([(r.artifact_id, kinds[r.artifact_id], r.score) for r in ranked if r.request_id == request], {x[0]: net(*x[1:]) for x in signals}, most)
                assert [(r.artifact_id, round(r.score, 6)) for r in got if r.request_id == request] == want
        told = {r.request_id: r.warnings for r in packs.pack_warnings(found, q).collect()}
        typed = [r for r in got if r.request_id == 1 and r.artifact_type != packs.RAW]
        assert (packs.THIN_WARNING in told[1]) == (len(typed) < 4)
        assert [w for w in told[1] if w.startswith("Missing")] == [packs.MISSING_WARNING + k for k in packs.PREFERRED if k not in {r.artifact_type for r in typed}]
