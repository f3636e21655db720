"""Hits of several stores as one bounded list for each query, under its plan and policy, and whether the web was used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stores in the order in which they are asked; of equal scores the earlier one's hit comes first.
STORES = ("vector", "lexical", "graph", "episodic", "web", "task", "profile", "reasoning")
#: Stores that only a policy of this mode asks.
TASK_MODE, TASK_STORES = "task_memory", ("task", "profile", "reasoning")
MOST_WEB = 2
#: Why the web was or wasn't used.
BLOCKED = "web requested by plan but blocked by policy"
USED = "web used because plan requested it and policy allowed it"
NOTHING = "web allowed but search returned no usable results"
NOT_ASKED = "web not requested by plan"

PLAN = ("use_internal", "use_graph", "use_episodic", "use_web")
POLICY = ("allow_episodic", "allow_web", "allow_task", "allow_profile", "allow_reasoning")


def _ruled(plans: DataFrame) -> DataFrame:
    """Plans without nulls: an unsaid use is none, an unsaid permission is given, that of the web if the plan uses it."""
    rows = plans.select("query_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in PLAN), *POLICY, F.coalesce("mode", F.lit("")).alias("mode"))
    return rows.withColumns({c: F.coalesce(c, "use_web" if c == "allow_web" else F.lit(True)) for c in POLICY})


def admitted(hits: DataFrame, plans: DataFrame) -> DataFrame:
    """The hits (query_id, store, chunk_id, source_type, score) of stores that their query's plan and policy ask.

    Without episodes the vector store gives documents alone.  Hits of a query without a plan, and of other stores, go."""
    task = F.col("mode") == TASK_MODE
    asks = F.when(F.col("store") == "vector", F.col("use_internal") & (F.col("allow_episodic") | (F.col("source_type") == "document")))
    asks = asks.when(F.col("store") == "lexical", F.col("use_internal")).when(F.col("store") == "graph", F.col("use_graph"))
    asks = asks.when(F.col("store") == "episodic", F.col("use_episodic") & F.col("allow_episodic")).when(F.col("store") == "web", F.col("use_web") & F.col("allow_web"))
    for s in TASK_STORES:
        asks = asks.when(F.col("store") == s, task & F.col(f"allow_{s}"))
    return hits.select("query_id", "store", "chunk_id", "source_type", "score").join(_ruled(plans), "query_id").where(asks).select("query_id", "store", "chunk_id", "source_type", "score")


def bundled(hits: DataFrame, most: int) -> DataFrame:
    """(query_id, rank, chunk_id, source_type, final_score, ranking_reason): the best `most` hits of each query, then
    without web hits after the first MOST_WEB.

    A chunk found twice keeps its highest score, the earlier store's of equal ones, and its first place among equals.  A
    null score counts as 0.  Each store's hits of a query are few, so a query is a small group.
    """
    place = F.create_map(*(F.lit(x) for i, s in enumerate(STORES) for x in (s, i)))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    rows = hits.select("query_id", "chunk_id", "source_type", score.alias("score"), place[F.col("store")].alias("at"))
    once = rows.groupBy("query_id", "chunk_id").agg(F.min(F.struct("at", -F.col("score"), "chunk_id")).alias("first"), F.max(F.struct("score", -F.col("at"), "source_type")).alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.col("best.score").desc(), "first")
    web = F.col("source_type") == "web"
    cut = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("query_id", "chunk_id", "best.source_type", "best.score", "n")
    kept = cut.withColumn("webs", F.count_if(web).over(Window.partitionBy("query_id").orderBy("n"))).where(~F.coalesce(web, F.lit(False)) | (F.col("webs") <= MOST_WEB))
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("n")))
    reason = F.concat(F.lit("source="), F.coalesce("source_type", F.lit("")), F.lit(";score="), F.col("score").cast("string"))
    return ranked.select("query_id", "rank", "chunk_id", "source_type", F.col("score").alias("final_score"), reason.alias("ranking_reason"))


def augmentation(chunks: DataFrame, plans: DataFrame) -> DataFrame:
    """(query_id, considered, allowed, used, reason) of every plan: whether the web was asked for, permitted, and is in the list."""
    used = chunks.where("source_type = 'web'").select("query_id", F.lit(True).alias("found")).distinct()
    rows = _ruled(plans).join(used, "query_id", "left").select("query_id", F.col("use_web").alias("considered"), F.col("allow_web").alias("allowed"), F.col("found").isNotNull().alias("used"))
    why = F.when(~F.col("considered"), NOT_ASKED).when(~F.col("allowed"), BLOCKED).when(F.col("used"), USED).otherwise(NOTHING)
    return rows.withColumn("reason", why)
