"""Skill packs: for each request the best artifacts of each type, within the type's quota, adjusted by what the graph says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nearest import rank_artifacts
from .rank import clamp

#: Types in the order in which a pack takes them, and how many of each.
TYPE_ORDER = ("principle", "template", "rubric", "workflow", "anti_pattern", "style_note", "execution_lesson", "evaluation_lesson", "example", "raw_chunk")
QUOTAS = {"principle": 5, "template": 2, "example": 3, "rubric": 1, "anti_pattern": 1, "workflow": 1, "style_note": 1, "execution_lesson": 1, "evaluation_lesson": 1, "raw_chunk": 2}
RAW, ENOUGH_TYPED, THIN = "raw_chunk", 6, 4
PREFERRED = ("principle", "template", "example")
THIN_WARNING, MISSING_WARNING = "Skill pack coverage is thin; insufficient distilled artifacts for this request.", "Missing preferred artifact type: "
#: What uses, reinforcements, critiques and supports of an artifact count, and the bounds of that.
LEAST_HISTORY, REINFORCED, USED, SUPPORTED, CRITICISED = 2, 1.6, 0.4, 0.2, 1.5
MOST_BOOST, MOST_SUPPORT, MOST_PENALTY = 5.0, 1.0, 4.5


def graph_adjustment(uses: Column, reinforces: Column, critiques: Column, supports: Column) -> Column:
    """What an artifact's history adds to its score; too short a history adds nothing."""
    boost = F.least(F.lit(MOST_BOOST), reinforces * REINFORCED + uses * USED + F.least(F.lit(MOST_SUPPORT), supports * SUPPORTED))
    penalty = F.least(F.lit(MOST_PENALTY), critiques * CRITICISED)
    return F.when(uses + reinforces + critiques < LEAST_HISTORY, 0.0).otherwise(clamp(boost - penalty, -MOST_PENALTY, MOST_BOOST))


def skill_packs(artifacts: DataFrame, requests: DataFrame, signals: DataFrame, most: int, quotas: dict[str, int] = QUOTAS) -> DataFrame:
    """(request_id, place, artifact_id, artifact_type, score, adjustment): each request's pack in its order.

    artifacts and requests as for nearest.rank_artifacts; signals: artifact_id, uses, reinforces, critiques, supports.  A
    pack holds `most` artifacts at most; raw chunks come last, and only where fewer than ENOUGH_TYPED others were taken.
    Only a quota's best of each type are kept for a request, so what is gathered for one doesn't grow with the artifacts."""
    counts = [F.coalesce(F.col(c), F.lit(0)) for c in ("uses", "reinforces", "critiques", "supports")]
    rows = artifacts.join(signals, "artifact_id", "left").withColumn("adjustment", graph_adjustment(*counts)).select(*artifacts.columns, "adjustment")
    out = None
    for n, kind in enumerate(TYPE_ORDER):
        if quotas.get(kind, 0) > 0:
            best = rank_artifacts(rows.where(F.col("artifact_type") == kind), requests, quotas[kind]).select("*", F.lit(kind).alias("artifact_type"), F.lit(n).alias("rank"))
            out = best if out is None else out.unionByName(best)
    per = Window.partitionBy("request_id").orderBy("rank", F.col("score").desc(), "artifact_id")
    placed = out.withColumn("place", F.row_number().over(per).cast("long")).where(F.col("place") <= most)
    typed = F.count_if(F.col("artifact_type") != RAW).over(Window.partitionBy("request_id"))
    kept = placed.withColumn("typed", typed).where((F.col("artifact_type") != RAW) | (F.col("typed") < ENOUGH_TYPED))
    return kept.join(rows.select("artifact_id", "adjustment"), "artifact_id").select("request_id", "place", "artifact_id", "artifact_type", "score", "adjustment")


def pack_warnings(packs: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, warnings): what each request's pack lacks; a request without a pack lacks everything."""
    has = [F.max(F.col("artifact_type") == kind).alias(kind) for kind in PREFERRED]
    told = packs.groupBy("request_id").agg(F.count_if(F.col("artifact_type") != RAW).alias("typed"), *has)
    thin = F.when(F.coalesce("typed", F.lit(0)) < THIN, F.lit(THIN_WARNING))
    missing = [F.when(~F.coalesce(kind, F.lit(False)), F.lit(MISSING_WARNING + kind)) for kind in PREFERRED]
    return requests.select("request_id").distinct().join(told, "request_id", "left").select("request_id", F.array_compact(F.array(thin, *missing)).alias("warnings"))
