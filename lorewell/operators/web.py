"""Web requests against what was fetched before, the log of fetches, and web hits ordered by how far they can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rank import clamp, top_k
from .skew import join_by_share
from .webfacts import FRESH, PENDING

#: How many cached results a request that must be fresh needs, and how many results a plan asks for.
LEAST_CACHED, MOST_RESULTS = 2, 5
LOG = "request_id long, query_variant string, status string, http_status int, error string, result_count long, fetched_at long"
#: What state, freshness, tier and contradiction add to the trust and the semantic score of a promoted fact.
TRUSTED = {FRESH: (0.08, 0.05), PENDING: (-0.10, -0.03), "else": (-0.08, -0.02)}
STAGED, TIER, CONTRADICTED = (-0.05, 0.0), {"global": (0.06, 0.03), "workspace": (0.03, 0.015)}, (-0.12, -0.04)
FACT_SCORES = {"lexical_score": 0.4, "semantic_score": 0.55, "recency_score": 0.4, "freshness_score": 0.7, "novelty_score": 0.35}
EVIDENCE_SCORES = {"lexical_score": 0.35, "semantic_score": 0.5, "recency_score": 0.4, "freshness_score": 0.6, "novelty_score": 0.45}
FACT_RISK, CLEAN_RISK, EVIDENCE_RISK = 0.65, 0.1, 0.15


def cached_at(requests: DataFrame, evidence: DataFrame, most: int = MOST_RESULTS) -> DataFrame:
    """requests (request_id, query, at, ...) with cached: how much evidence (query, evidence_id, fetched_at) for the same
    query had been fetched by then, `most` at most.

    Of each query only the first `most` fetches decide, so those alone meet the requests, as one row for each query."""
    first = top_k(evidence.where("query is not null and fetched_at is not null"), ["query"], [F.col("fetched_at"), F.col("evidence_id")], most)
    times = first.groupBy("query").agg(F.array_sort(F.collect_list("fetched_at")).alias("times"))
    n = requests.groupBy("query").agg(F.count("*").alias("n"))
    found = join_by_share(requests, n.join(times, "query", "left"), ["query"], "n", "left")
    return found.withColumn("cached", F.coalesce(F.size(F.filter("times", lambda t: t <= F.col("at"))), F.lit(0)).cast("long")).withColumn("cached", F.greatest("cached", F.lit(0).cast("long"))).drop("n", "times")


def enough() -> Column:
    """Whether the cache answers a request: with anything, or with LEAST_CACHED results where the answer must be fresh."""
    return (F.col("cached") > 0) & (~F.coalesce("sensitive", F.lit(False)) | (F.col("cached") >= LEAST_CACHED))


def fetch_log(requests: DataFrame, evidence: DataFrame, outcomes: DataFrame) -> DataFrame:
    """LOG rows of requests (request_id, query, at, sensitive, variants): a request that finds enough in the cache has one,
    any other one for each variant of its query, with what the provider made of it.

    outcomes: request_id, query_variant, n_results, error; a variant without an outcome found nothing."""
    asked = cached_at(requests, evidence)
    none = F.lit(None)
    kept = asked.where(enough()).select("request_id", F.col("query").alias("query_variant"), F.lit("cache_hit").alias("status"), none.cast("int").alias("http_status"), none.cast("string").alias("error"), F.col("cached").alias("result_count"), F.col("at").alias("fetched_at"))
    tried = asked.where(~enough()).select("request_id", F.explode("variants").alias("query_variant"), "at").join(outcomes, ["request_id", "query_variant"], "left")
    good = F.col("error").isNull()
    fetched = tried.select("request_id", "query_variant", F.when(good, "ok").otherwise("error").alias("status"), F.when(good, 200).alias("http_status"), "error", F.when(good, F.coalesce("n_results", F.lit(0))).otherwise(0).cast("long").alias("result_count"), F.col("at").alias("fetched_at"))
    return kept.unionByName(fetched)


def appended(batch: DataFrame, number: int, path: str) -> None:
    """Append a batch of log rows under its number: written again after a failure, it replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def recent(log: DataFrame, k: int) -> DataFrame:
    """The last k rows of a log, the latest first; later batches are later."""
    return log.orderBy(F.col("batch").desc(), F.col("fetched_at").desc(), F.col("request_id").desc(), F.col("query_variant").desc()).limit(k)


def _adjusted(part: int) -> Column:
    trusted, tier = F.col("state") == "trusted", F.col("tier")
    base = F.when(trusted & (F.col("lifecycle") == FRESH), TRUSTED[FRESH][part]).when(trusted & (F.col("lifecycle") == PENDING), TRUSTED[PENDING][part]).when(trusted, TRUSTED["else"][part]).otherwise(STAGED[part])
    wide = F.when(tier == "global", TIER["global"][part]).when(tier == "workspace", TIER["workspace"][part]).otherwise(0.0)
    return base + wide + F.when(F.col("contradicted"), CONTRADICTED[part]).otherwise(0.0)


def _place(column: str, *values: str) -> Column:
    out = F.lit(len(values))
    for i, v in enumerate(values):
        out = F.when(F.col(column) == v, i).otherwise(out)
    return out


def web_hits(facts: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """(query_id, id, memory_type, the scores, contradiction_risk, cluster_id, place): of each query the k first web hits.

    facts: query_id, fact_id, state, tier, lifecycle, contradicted, confidence; evidence: query_id, evidence_id, trust,
    source_id.  Facts come first: by tier, state, freshness, contradiction and trust; then evidence by trust; then by id."""
    trust = clamp(F.coalesce("confidence", F.lit(0.5)) + _adjusted(0), 0.0, 1.0)
    fixed = {**{c: F.lit(v) for c, v in FACT_SCORES.items()}, "semantic_score": FACT_SCORES["semantic_score"] + _adjusted(1), "trust_score": trust, "contradiction_risk": F.when(F.col("contradicted"), FACT_RISK).otherwise(CLEAN_RISK)}
    order = F.array(F.lit(0), _place("tier", "global", "workspace"), _place("state", "trusted"), _place("lifecycle", FRESH, PENDING), F.col("contradicted").cast("int"))
    cluster = F.concat_ws(":", F.lit("web_promoted"), "tier", "state", "lifecycle")
    left = facts.select("query_id", F.concat(F.lit("webpromoted:"), F.col("fact_id").cast("string")).alias("id"), F.lit("web_promoted_fact").alias("memory_type"), *(v.alias(c) for c, v in fixed.items()), cluster.alias("cluster_id"), order.alias("order"))
    more = {**{c: F.lit(v) for c, v in EVIDENCE_SCORES.items()}, "trust_score": F.coalesce(F.nullif(F.col("trust"), F.lit(0.0)), F.lit(0.5)), "contradiction_risk": F.lit(EVIDENCE_RISK)}
    right = evidence.select("query_id", F.concat(F.lit("webevidence:"), F.col("evidence_id").cast("string")).alias("id"), F.lit("web_evidence").alias("memory_type"), *(v.alias(c) for c, v in more.items()), F.coalesce("source_id", F.lit("web")).alias("cluster_id"), F.array(F.lit(1), *[F.lit(0)] * 4).alias("order"))
    w = Window.partitionBy("query_id").orderBy("order", F.round("trust_score", 9).desc(), "id")
    return left.unionByName(right).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k).drop("order")
