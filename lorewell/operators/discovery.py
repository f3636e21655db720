"""Bounded discovery: a query's probes look through its hits, each preferring what the ones before didn't show.

What a probe finds changes what counts as new for the next, so probes are a fold; a query's pool is its lanes' bounded
hits, one group of applyInPandas.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.functions import lexicons as lx

#: Fixed weights and limits.
RELEVANCE, NOVELTY, UNCERTAINTY, CONTRADICTION, FRONTIER = 0.35, 0.3, 0.15, 0.1, 0.1
HEDGES = frozenset(("maybe", "might", "unclear", "unknown", "possible", "possibly", "uncertain", "approximately"))
DEFAULT_PROBES = (("skeptic", "what contradicts: {query}"), ("domain specialist", "what else about: {query}"), ("ops reviewer", "edge cases of: {query}"))
#: Who probes for which intent, how a probe asks, and how the graph's helpers do.
ROLES = {
    "exact_recall": ("skeptic", "ops reviewer"),
    "memory_summary": ("architect", "skeptic", "domain specialist"),
    "architecture_explanation": ("architect", "security auditor"),
    "corpus_overview": ("domain specialist", "skeptic", "compliance reviewer"),
    "planning": ("ops reviewer", "architect", "security auditor"),
    "investigative": ("skeptic", "domain specialist", "security auditor", "ops reviewer"),
}
ASKS = "[{role}] Generate a bounded retrieval probe from this role perspective. Query: {query}. Target lanes: {lanes}."
HELPERS = {
    "category_graph": ("category:{name}", "Explore non-obvious risks and contradictions around category '{name}'."),
    "topic_graph": ("topic:{name}", "Check weak signals and contradiction edges around topic '{name}'."),
    "clustering": ("cluster:{name}", "Probe alternative interpretations within this cluster and surface conflicts."),
}
HELPER_LANES, CLUSTER_STRENGTH, LEAST_STRENGTH = ("semantic", "corpus", "episodic"), 0.45, 0.1
UNRESOLVED = "No discovery evidence passed branch quality thresholds."
#: How strong a contradiction is, and how many words two texts must share for one.
CONFLICT_BASE, CONFLICT_STEP, CONFLICT_WORDS = 0.3, 0.1, 2
OUT = "query_id long, branch_id string, probe string, score double, evidence_count int, status string, reason string, injected array<string>, used_tokens int, prompt string, helper_source string, helper_strength double, evidence array<string>, contradictions array<string>, unresolved string"

_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass(frozen=True)
class Limits:
    branches: int = 4
    evidence: int = 3
    least_score: float = 0.22
    least_evidence: int = 1
    budget: int = 220
    injected: int = 3


def terms(text: str) -> list[str]:
    return [t for t in _SPLIT.split((text or "").lower()) if len(t) >= 3]


def curiosity(own: list[str], query: frozenset[str], seen: set[str], risk: float, cluster: str | None) -> float:
    """How much a text is worth looking at: to the point, new, hedged, in conflict, of an unseen cluster."""
    n = len(own)
    fits = len(query.intersection(own)) / len(query) if query else 0.0
    new = sum(t not in seen for t in own) / n if n else 0.0
    hedged = min(1.0, sum(t in HEDGES for t in own) / max(1, n // 4)) if n else 0.0
    total = RELEVANCE * fits + NOVELTY * new + UNCERTAINTY * hedged + CONTRADICTION * min(1.0, risk) + FRONTIER * bool(cluster and cluster not in seen)
    return round(max(0.0, min(1.0, total)), 6)


@dataclass(frozen=True)
class Probe:
    """What is asked; lanes: whose hits answer, all if empty.  source, strength and reason: of a helper's suggestion."""

    role: str
    prompt: str
    lanes: tuple[str, ...] = ()
    source: str | None = None
    strength: float | None = None
    reason: str | None = None


def probes_for(intent: str, query: str, most: int = 4) -> list[Probe]:
    """The roles that an intent calls for, each asking the lanes that it is routed to."""
    lanes = lx.LANES[intent if intent in lx.LANES else lx.OTHER_INTENT]
    roles = ROLES.get(intent, ROLES[lx.OTHER_INTENT])[: max(1, most)]
    return [Probe(r, ASKS.format(role=r, query=query.strip() or "(empty query)", lanes=", ".join(lanes)), lanes) for r in roles]


def helper_probes(pool: list[dict], most: int) -> list[Probe]:
    """Suggestions of the graph: each hit's best category and topic and its cluster, the strongest first, each once."""
    found = {}
    for c in pool:
        for source, rows in (("category_graph", c.get("categories")), ("topic_graph", c.get("topics"))):
            if rows is not None and len(rows):
                found.setdefault((source, rows[0]["name"]), []).append(max(LEAST_STRENGTH, min(1.0, rows[0]["score"])))
        if c["cluster_id"]:
            found.setdefault(("clustering", c["cluster_id"]), []).append(CLUSTER_STRENGTH)
    best = sorted((-max(s), source, HELPERS[source][0].format(name=name), name) for (source, name), s in found.items())
    return [Probe(f"graph-helper-{source}", HELPERS[source][1].format(name=name), HELPER_LANES, source, -s, reason) for s, source, reason, name in best[: max(1, most)]]


def polarity(own: set[str]) -> str:
    """negative, positive or mixed, by the words of a text."""
    bad, good = bool(own.intersection(lx.NEGATIVE)), bool(own.intersection(lx.POSITIVE))
    if own.intersection(lx.STRONG_NEGATIVE) or bad and not good:
        return "negative"
    return "positive" if good and not bad else "mixed"


def conflicts(evidence: list[tuple[str, set[str]]]) -> list[tuple[str, str, float]]:
    """(left, right, strength) of the evidence (name, words) that says opposite things about the same."""
    said = [(name, own, polarity(own)) for name, own in evidence]
    out = []
    for i, (left, own, pole) in enumerate(said):
        for right, other, opposite in said[i + 1 :]:
            shared = len(own & other)
            if {pole, opposite} == {"negative", "positive"} and shared >= CONFLICT_WORDS:
                out.append((left, right, round(min(1.0, CONFLICT_BASE + CONFLICT_STEP * shared), 4)))
    return out


def explore(pool: list[dict], probes: list[Probe], limits: Limits) -> list[dict]:
    """A row for each branch, with what it found, what of that is injected and what it contradicts."""
    words = [terms(c["text"]) for c in pool]
    seen: set[str] = set()
    branches = []
    for n, probe in enumerate(probes[: 2 * limits.branches], 1):
        asked = frozenset(terms(probe.prompt))
        heard = [i for i, c in enumerate(pool) if not probe.lanes or c.get("lane") in probe.lanes]
        scored = sorted((-curiosity(words[i], asked, seen, pool[i].get("contradiction_risk") or 0.0, pool[i]["cluster_id"]), pool[i]["id"], i) for i in heard)
        top = [(-s, i) for s, _, i in scored if -s > 0.01][: limits.evidence]
        for _, i in top:
            seen.update(words[i])
        branches.append({"branch_id": f"branch-{n:02d}", "probe": probe.role, "score": round(sum(s for s, _ in top) / (len(top) or 1), 6), "top": top, "prompt": probe.prompt, "helper_source": probe.source, "helper_strength": probe.strength, "why": probe.reason})
    explored = 0
    found = []
    for b in sorted(branches, key=lambda b: (-b["score"], -len(b["top"]), b["branch_id"])):
        refused = "low_score" if b["score"] < limits.least_score else "insufficient_evidence" if len(b["top"]) < limits.least_evidence else "branch_budget_exceeded" if explored >= limits.branches else None
        b |= {"status": "rejected" if refused else "explored", "reason": refused or b["why"]}
        if not refused:
            explored += 1
            found += [(-s, f"{b['branch_id']}:{pool[i]['id']}", i) for s, i in b["top"]]
    opposed = conflicts([(name, set(words[i])) for _, name, i in found])
    injected, used = [], 0
    for _, name, i in sorted(found):
        if len(injected) < limits.injected and used + pool[i]["tokens"] <= limits.budget:
            injected.append(f"discovery:{name}")
            used += pool[i]["tokens"]
    for b in branches:
        lead = f"{b['branch_id']}:"
        names = [f"{lead}{pool[i]['id']}" for _, i in b["top"]]
        b |= {"evidence_count": len(names), "evidence": names, "injected": [x for x in injected if x.startswith(f"discovery:{lead}")], "used_tokens": used}
        b |= {"contradictions": [f"{x}|{y}|{s}" for x, y, s in opposed if x.startswith(lead)], "unresolved": None if found else UNRESOLVED}
    return branches


def discover(hits: DataFrame, probes: tuple[tuple[str, str], ...] = DEFAULT_PROBES, limits: Limits = Limits()) -> DataFrame:
    """OUT for each query of hits (query_id, query, id, text, tokens, cluster_id; if there: contradiction_risk, lane, intent,
    and categories and topics as graphs.annotated gives them).

    With intents and lanes the roles of a query's intent probe the lanes that it is routed to, else `probes` (role, prompt
    with {query}) look at all hits; with categories the graph's suggestions follow as further probes."""
    names = [c.split()[0] for c in OUT.split(", ")]
    have = set(hits.columns)
    columns = ["query_id", "query", "id", "text", "tokens", "cluster_id", *(c for c in ("contradiction_risk", "lane", "intent", "categories", "topics") if c in have)]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = pdf.sort_values("id").to_dict("records")
        query = pool[0]["query"]
        asked = probes_for(pool[0]["intent"], query) if {"intent", "lane"} <= have else [Probe(role, prompt.replace("{query}", query)) for role, prompt in probes]
        if "categories" in have:
            asked += helper_probes(pool, limits.branches)
        rows = explore(pool, asked, limits)
        return pd.DataFrame([{"query_id": pool[0]["query_id"], **r} for r in rows], columns=names)

    return hits.select(*columns).where(F.col("query").isNotNull()).groupBy("query_id").applyInPandas(fold, OUT)
