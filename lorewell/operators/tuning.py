"""Evaluation runs and proposals to change the retrieval's settings; none of them ever acts by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a proposal and the reasons of its rollback state.
DRAFT, REJECTED = "draft", "rejected"
NOT_APPLIED, NO_REASON = "proposal_not_applied", "rejected"
UNKNOWN_RUN = "unknown evaluation run_id: "
BASELINE = {"selector_authority": "default", "retrieval_ranking": "default", "discovery_bounds": "default"}


def _by_key(entries: str) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(entries)))


def _stable_id(prefix: str, *fields: str) -> Column:
    """Of the fields as one line of JSON with sorted keys, numbers as Spark writes them."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})), 1, 20))


def _trimmed(x: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(x), F.lit("")), r"^\s+|\s+$", "")


def evaluation_runs(runs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(run_id, scenario_ids, artifact_refs, metrics_before, summary, and the columns of `carry`) of runs with these.

    A null list or map is an empty one.  The id names the content: rows of equal content are one run, and carry the least
    of their other values.
    """
    lists = {c: F.array_sort(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in ("scenario_ids", "artifact_refs")}
    before = F.coalesce(F.col("metrics_before"), F.create_map().cast("map<string,double>"))
    rows = runs.withColumns(lists | {"metrics_before": before, "summary": _trimmed("summary")}).withColumn("metrics_before", _by_key("metrics_before"))
    rows = rows.withColumn("run_id", _stable_id("evalrun", "scenario_ids", "artifact_refs", "metrics_before", "summary"))
    content = [F.any_value(c).alias(c) for c in ("scenario_ids", "artifact_refs", "metrics_before", "summary")]
    return rows.groupBy("run_id").agg(*content, *(F.min(c).alias(c) for c in carry))


def proposals(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """A draft for each candidate (run_id, candidate_patch, metrics_after, rationale): proposal_id, run_id, status,
    authoritative, candidate_patch, metrics_before, metrics_after, delta (over the metrics of either side, a missing one
    counts as 0), rationale, reason (of the rollback state), error.

    A candidate of a run that isn't there gives a row with an error and no id.  Equal candidates are one proposal.
    """
    empty = F.create_map().cast("map<string,double>")
    rows = candidates.select("run_id", F.coalesce("candidate_patch", F.create_map().cast("map<string,string>")).alias("candidate_patch"), F.coalesce("metrics_after", empty).alias("metrics_after"), F.coalesce("rationale", F.lit("")).alias("rationale"))
    rows = rows.withColumns({c: _by_key(c) for c in ("candidate_patch", "metrics_after")})
    rows = rows.withColumn("proposal_id", _stable_id("tuneprop", "run_id", "candidate_patch", "metrics_after", "rationale"))
    rows = rows.groupBy("proposal_id").agg(*(F.any_value(c).alias(c) for c in ("run_id", "candidate_patch", "metrics_after", "rationale")))
    rows = rows.join(runs.select("run_id", "metrics_before", F.lit(True).alias("known")), "run_id", "left")
    before, after = F.col("metrics_before"), F.col("metrics_after")
    keys = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    value = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    delta = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, value(after, k) - value(before, k))))
    known = F.col("known").isNotNull()
    error = F.when(~known, F.concat(F.lit(UNKNOWN_RUN), F.coalesce("run_id", F.lit(""))))
    return rows.select(F.when(known, F.col("proposal_id")).alias("proposal_id"), "run_id", F.when(known, DRAFT).alias("status"), F.when(known, F.lit(False)).alias("authoritative"), "candidate_patch", "metrics_before", "metrics_after", F.when(known, delta).alias("delta"), _trimmed("rationale").alias("rationale"), F.when(known, NOT_APPLIED).alias("reason"), error.alias("error"))


def rejected(made: DataFrame, rejections: DataFrame) -> DataFrame:
    """The proposals, those with a rejection (proposal_id, at, reason) rejected for the latest one's reason.

    An empty or null reason is `rejected`; of rejections at one time the greatest reason holds.  Rejections of proposals
    that aren't there change nothing (`unknown_rejections` lists them).
    """
    w = Window.partitionBy("proposal_id").orderBy(F.col("at").desc(), F.col("why").desc())
    last = rejections.select("proposal_id", "at", _trimmed("reason").alias("why")).withColumn("n", F.row_number().over(w)).where("n = 1")
    last = last.select("proposal_id", F.when(F.col("why") == "", NO_REASON).otherwise(F.col("why")).alias("why"))
    rows = made.join(last, "proposal_id", "left")
    gone = F.col("why").isNotNull()
    return rows.withColumns({"status": F.when(gone, REJECTED).otherwise(F.col("status")), "reason": F.coalesce("why", "reason")}).drop("why").select(*made.columns)


def unknown_rejections(made: DataFrame, rejections: DataFrame) -> DataFrame:
    return rejections.join(made.select("proposal_id"), "proposal_id", "left_anti")


def effective_policy(made: DataFrame) -> DataFrame:
    """One row (source, applied_proposal_id, policy): the baseline, as drafts and rejected proposals have no authority."""
    applied = F.max(F.when(F.col("authoritative"), F.col("proposal_id")))
    policy = F.create_map(*(F.lit(x) for pair in BASELINE.items() for x in pair))
    return made.agg(applied.alias("applied_proposal_id")).select(F.lit("baseline").alias("source"), "applied_proposal_id", policy.alias("policy"))
