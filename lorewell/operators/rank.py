"""Ranking of hits: top k of a group, bounded rerank, order of anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed weights of the bounded rerank: what a hit's own scores, its lane's place and its helpers count.
BASE = {"semantic_score": 0.45, "lexical_score": 0.35, "trust_score": 0.20}
HELPERS = {"lexical_fit": 0.10, "category_fit": 0.08, "graph_support": 0.05, "reuse_signal": 0.04, "success_confidence": 0.03, "tier_bonus": 0.03, "freshness_penalty": -0.08, "contradiction_penalty": -0.10}
HELPER_BOUND, LANE_STEP, BASE_SHARE, LANE_SHARE, WEAK = 0.22, 0.07, 0.55, 0.25, 0.25


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts each task's groups before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= k).drop("_place")


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))


def overlap_ratio(query: Column, text: Column) -> Column:
    """Share of a query's words in a text."""
    q = words(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(text))) / F.size(q)).otherwise(0.0)


def rerank(hits: DataFrame) -> DataFrame:
    """Hits with final_score, place and applied.

    hits: query_id, query, ord, id, lane, lane_index (null if the plan lacks the lane), text, the scores, and optionally
    category_fit, graph_support_count, reuse_count, success_confidence, promotion_tier, freshness_state,
    contradiction_risk.  A query with one hit, without words or whose scores are all weak keeps its order.
    """
    have = set(hits.columns)
    opt = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)
    signals = {
        "lexical_fit": overlap_ratio(F.col("query"), F.col("text")),
        "category_fit": opt("category_fit", 0.0),
        "graph_support": clamp(opt("graph_support_count", 0) / 3.0, 0.0, 1.0),
        "reuse_signal": clamp((opt("reuse_count", 0) - 1) / 6.0, 0.0, 1.0),
        "success_confidence": clamp(opt("success_confidence", 0.0), 0.0, 1.0),
        "tier_bonus": F.when(opt("promotion_tier", "") == "global", 1.0).when(opt("promotion_tier", "") == "workspace", 0.5).otherwise(0.0),
        "freshness_penalty": F.when(opt("freshness_state", "") == "stale", 1.0).when(opt("freshness_state", "") == "revalidation_pending", 0.6).otherwise(0.0),
        "contradiction_penalty": F.when(opt("contradiction_risk", 0.0) >= 0.4, 1.0).otherwise(0.0),
    }
    base = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in BASE.items()), F.lit(0.0))
    helper = clamp(sum((signals[c] * w for c, w in HELPERS.items()), F.lit(0.0)), -HELPER_BOUND, HELPER_BOUND)
    lane = clamp(1.0 - F.coalesce("lane_index", F.lit(999)) * LANE_STEP, 0.0, 1.0)
    scored = hits.withColumn("final_score", BASE_SHARE * base + LANE_SHARE * lane + helper)
    per = Window.partitionBy("query_id")
    applied = (F.count("*").over(per) > 1) & (F.size(words(F.col("query"))) > 0) & (F.max(F.abs("final_score")).over(per) >= WEAK)
    scored = scored.withColumn("applied", applied)
    order = per.orderBy(F.when(F.col("applied"), -F.round("final_score", 9)), F.when(F.col("applied"), F.col("id")), "ord")
    return scored.withColumn("place", F.row_number().over(order)).withColumn("final_score", F.round("final_score", 6))
