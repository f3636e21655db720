"""Context selection under a token budget: pruning, greedy choice by utility for each token, order of anchors.

What doesn't depend on what was chosen before is computed as columns; the rest is a fold over one query's few hits, one
group of applyInPandas for each query.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions import lexicons as lx

#: Fixed limits of pruning: tokens above which a compressible hit is split, below which neighbours are merged.
SPLIT_TOKENS, TINY_TOKENS = 320, 32
CONTRADICTION = 0.95
FRONT, BACK = 2, 2
NO_MAXIMUM = 999_999
OUT = "query_id long, id string, lane string, tokens int, utility double, status string, reason string, place int"

_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass(frozen=True)
class Policy:
    """An intent's weights and the lanes' minima and maxima."""

    intent: str
    minima: dict = field(default_factory=dict)
    maxima: dict = field(default_factory=dict)
    redundancy: float = 0.0
    cluster_bonus: float = lx.CLUSTER_BONUS

    @classmethod
    def of(cls, intent: str) -> Policy:
        return cls(intent, lx.LANE_MINIMA | lx.LANE_MINIMA_BY_INTENT.get(intent, {}), lx.LANE_MAXIMA | lx.LANE_MAXIMA_BY_INTENT.get(intent, {}), lx.WEIGHTS[intent][6])


def estimate(text: str) -> int:
    return max(1, (len(text) + 3) // 4)


def intent_fit(intent: str) -> Column:
    """How a hit's lane and type suit an intent."""
    lane, kind = F.col("lane"), F.col("memory_type")
    if intent == "exact_recall":
        return F.when(lane.isin("episodic", "fresh_tail"), 1.0).when(kind == "summary", 0.1).otherwise(0.2)
    if intent == "memory_summary":
        return F.when(kind.isin("summary", "promoted_fact", "architecture_note"), 1.0).when(lane == "episodic", 0.35).otherwise(0.5)
    if intent == "architecture_explanation":
        return F.when(lane == "architecture", 1.0).otherwise(0.2)
    if intent == "corpus_overview":
        return F.when(lane.isin("corpus", "large_file"), 1.0).when(lane == "fresh_tail", 0.35).otherwise(0.2)
    if intent == "planning":
        return F.when(lane.isin("fresh_tail", "episodic"), 1.0).when(lane == "lexical", 0.8).when(lane == "promoted", 0.65).when(lane == "session_summary", 0.25).otherwise(0.35)
    return F.when(lane.isin("corpus", "large_file", "promoted", "episodic"), 0.8).otherwise(0.45)


def fixed_utility(intent: str) -> Column:
    """The part of a hit's utility that no other hit changes."""
    rel, prov, rec, fresh, nov, fit, _, con = lx.WEIGHTS[intent]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rel * (zero("lexical_score") + zero("semantic_score")) / 2 + prov * F.when(F.col("has_provenance"), 1.0).otherwise(0.2) + rec * zero("recency_score") + fresh * (zero("freshness_score") + zero("trust_score")) / 2 + nov * zero("novelty_score") + fit * intent_fit(intent) - con * zero("contradiction_risk")


def polarity(tokens: frozenset[str]) -> str:
    if tokens & set(lx.STRONG_NEGATIVE):
        return "negative"
    sides = bool(tokens & set(lx.NEGATIVE)), bool(tokens & set(lx.POSITIVE))
    return {(True, False): "negative", (False, True): "positive"}.get(sides, "mixed")


def split_words(text: str, most: int) -> list[str]:
    """Runs of words, each closed by the word with which its estimate reaches the limit."""
    out, begin, words, size = [], 0, text.split(), -1
    for i, w in enumerate(words):
        size += len(w) + 1
        if estimate_of(size) >= most:
            out.append(" ".join(words[begin : i + 1]))
            begin, size = i + 1, -1
    if begin < len(words):
        out.append(" ".join(words[begin:]))
    return out or [text]


def estimate_of(length: int) -> int:
    return max(1, (length + 3) // 4)


def pruned(hits: list[dict], most: int = SPLIT_TOKENS) -> list[dict]:
    """Oversized compressible hits in parts, tiny neighbours of one lane and cluster as one (which may merge again)."""
    parts: list[dict] = []
    for h in hits:
        if h["compressible"] and h["tokens"] > most:
            texts = split_words(h["text"], most)
            parts += [h | {"id": f"{h['id']}#part{i}", "text": t, "tokens": estimate(t)} for i, t in enumerate(texts)] if h["text"].split() else [h]
        else:
            parts.append(h)
    out: list[dict] = []
    for h in parts:
        last = out[-1] if out else None
        if last and all(x["compressible"] and x["tokens"] < TINY_TOKENS for x in (last, h)) and h["lane"] == last["lane"] != "fresh_tail" and h["cluster_id"] == last["cluster_id"]:
            text = f"{last['text']}\n{h['text']}".strip()
            out[-1] = last | {"id": f"{last['id']}+{h['id']}", "text": text, "tokens": estimate(text)}
        else:
            out.append(h)
    return out


class Selection:
    """The fold over one query's candidates.  Redundancy is kept up incrementally: choosing a candidate updates the
    others' greatest overlap once, so a round costs a comparison of numbers and no comparison of texts."""

    def __init__(self, hits: list[dict], policy: Policy, budget: int, reserved: int):
        self.hits, self.policy, self.budget, self.used = hits, policy, budget, reserved
        self.words = [frozenset((h["text"] or "").lower().split()) for h in hits]
        self.tokens = [frozenset(t for t in _SPLIT.split((h["text"] or "").lower()) if len(t) >= 3) for h in hits]
        self.sides = [polarity(t) for t in self.tokens]
        self.fixed = np.array([h["fixed"] for h in hits], dtype=float)
        self.size = np.array([max(1, h["tokens"]) for h in hits], dtype=float)
        self.overlap = np.zeros(len(hits))
        self.bonus = np.array([policy.cluster_bonus if h["cluster_id"] else 0.0 for h in hits])
        self.chosen: list[tuple[int, float]] = []
        self.dropped: list[tuple[int, str]] = []
        self.lanes: dict[str, int] = {}

    def utility(self, i: int) -> float:
        return self.fixed[i] - self.policy.redundancy * self.overlap[i] + self.bonus[i]

    def conflict(self, i: int) -> bool:
        h = self.hits[i]
        for j, _ in self.chosen:
            o = self.hits[j]
            if h["claim_key"] and h["claim_key"] == o["claim_key"] and h["claim_value"] and o["claim_value"] and h["claim_value"] != o["claim_value"]:
                return True
            if "mixed" not in (self.sides[i], self.sides[j]) and self.sides[i] != self.sides[j] and len(self.tokens[i] & self.tokens[j]) >= 2:
                return True
        return False

    def offer(self, i: int) -> bool:
        """Choose a candidate, or note why not."""
        h = self.hits[i]
        if self.conflict(i):
            self.dropped.append((i, "compatibility_conflict"))
        elif self.used + h["tokens"] > self.budget or self.lanes.get(h["lane"], 0) >= self.policy.maxima.get(h["lane"], NO_MAXIMUM):
            self.dropped.append((i, "budget_or_lane_cap"))
        else:
            self.chosen.append((i, float(self.utility(i))))
            self.used += h["tokens"]
            self.lanes[h["lane"]] = self.lanes.get(h["lane"], 0) + 1
            for j, w in enumerate(self.words):
                if w:
                    self.overlap[j] = max(self.overlap[j], len(w & self.words[i]) / len(w))
                if h["cluster_id"] and self.hits[j]["cluster_id"] == h["cluster_id"]:
                    self.bonus[j] = 0.0
            return True
        return False

    def best(self, among: list[int]) -> int:
        return min(among, key=lambda i: (-self.utility(i) / self.size[i], -self.utility(i), self.hits[i]["id"]))

    def run(self) -> Selection:
        risky = {i for i, h in enumerate(self.hits) if (h["contradiction_risk"] or 0.0) > CONTRADICTION}
        self.dropped += [(i, "contradiction_risk") for i in sorted(risky)]
        left = [i for i in range(len(self.hits)) if i not in risky]
        for i in sorted((i for i in left if self.hits[i]["must_include"]), key=lambda i: (self.hits[i]["tokens"], self.hits[i]["id"])):
            self.offer(i)
        done = {i for i, _ in self.chosen}
        left = [i for i in left if i not in done]
        for lane, least in sorted(self.policy.minima.items()):
            while self.lanes.get(lane, 0) < least and (own := [i for i in left if self.hits[i]["lane"] == lane]):
                i = self.best(own)
                left.remove(i)
                self.offer(i)
        while left:
            i = self.best(left)
            left.remove(i)
            self.offer(i)
        return self

    def ordered(self) -> list[tuple[int, float]]:
        """Anchors at the front and the back, must-haves and high utility first."""
        by = sorted(self.chosen, key=lambda c: (not self.hits[c[0]]["must_include"], -c[1], self.hits[c[0]]["id"]))
        front = by[: min(FRONT, len(by))]
        rest = by[len(front) :]
        cut = len(rest) - min(BACK, len(rest))
        plain = lambda part: sorted(part, key=lambda c: (-c[1], self.hits[c[0]]["id"]))
        return front + plain(rest[:cut]) + plain(rest[cut:])


def by_intent(make) -> Column:
    """make(intent) of each row's intent; an unknown one counts as the usual one."""
    out = make(lx.OTHER_INTENT)
    for intent in lx.WEIGHTS:
        out = F.when(F.col("intent") == intent, make(intent)).otherwise(out)
    return out


def select_context(hits: DataFrame, intent: str | None = None, budget: int = 1400, reserved: int = 256) -> DataFrame:
    """Chosen and dropped hits of each query: OUT.

    hits: query_id, ord, id, lane, memory_type, text, tokens, scores, cluster_id, must_include, compressible, claim_key,
    claim_value, has_provenance, and intent (the query's) where no intent is given for all.  Repeated texts of a lane count
    once, in their first place.  Lanes return a bounded number of hits for a query, so a group is small however large the
    tables are; all intents go through one fold.
    """
    hits = hits if intent is None else hits.withColumn("intent", F.lit(intent))
    policies = {i: Policy.of(i) for i in lx.WEIGHTS}
    text = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    first = Window.partitionBy("query_id", "lane", text).orderBy("ord")
    rows = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("fixed", by_intent(fixed_utility))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        pdf = pdf.astype(object).where(pdf.notna(), None)
        policy = policies.get(pdf["intent"].iloc[0], policies[lx.OTHER_INTENT])
        s = Selection(pruned(pdf.to_dict("records")), policy, budget, reserved).run()
        query = pdf["query_id"].iloc[0]
        row = lambda i, u, status, reason, place: (query, s.hits[i]["id"], s.hits[i]["lane"], s.hits[i]["tokens"], round(u, 6) if u is not None else None, status, reason, place)
        out = [row(i, u, "selected", None, n) for n, (i, u) in enumerate(s.ordered())] + [row(i, None, "dropped", why, None) for i, why in s.dropped]
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return rows.groupBy("query_id").applyInPandas(fold, OUT)


def pruned_hits(hits: DataFrame, most: int = SPLIT_TOKENS) -> DataFrame:
    """(query_id, ord, id, lane, tokens, text): hits after pruning, in their order; hits as for select_context.

    Repeated texts of a lane count once; what is split or merged keeps its ids' parts in its own."""
    text = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    first = Window.partitionBy("query_id", "lane", text).orderBy("ord")
    rows = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("query_id", "ord", "id", "lane", "text", "tokens", "cluster_id", "compressible")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        pdf = pdf.astype(object).where(pdf.notna(), None)
        kept = pruned(pdf.to_dict("records"), most)
        return pd.DataFrame([(h["query_id"], n, h["id"], h["lane"], h["tokens"], h["text"]) for n, h in enumerate(kept)], columns=["query_id", "ord", "id", "lane", "tokens", "text"])

    return rows.groupBy("query_id").applyInPandas(fold, "query_id long, ord long, id string, lane string, tokens int, text string")


def against_selected(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """candidates (query_id, id, claim_key, claim_value) with conflict: whether a selected hit of the query claims another
    value of the same key.  Claims without key or value conflict with nothing.

    Of the selected hits only the least and the greatest value of each key matter, so both sides meet one to many."""
    ends = selected.where("claim_key <> '' and claim_value <> ''").groupBy("query_id", "claim_key").agg(F.min("claim_value").alias("low"), F.max("claim_value").alias("high"))
    value = F.col("claim_value")
    other = (value != "") & ((F.col("low") != value) | (F.col("high") != value))
    return candidates.join(ends, ["query_id", "claim_key"], "left").withColumn("conflict", F.coalesce(other, F.lit(False))).select(*candidates.columns, "conflict")
