"""Lessons from execution and evaluation cases, and evaluations ranked as examples to follow or to avoid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rank
from .distil import one_line, stripped
from .nearest import token_set

#: Cases that a request gets lessons from, what a lesson quotes, how sure it is.
CASES, QUOTED, NAMED_ARTIFACTS, NAMED_NOTES = 20, 160, 4, 3
SUCCEEDED, FAILED, EVALUATED = 0.85, 0.65, 0.88
EXECUTION = "Execution lesson: For %s, a %s run used artifacts %s; request='%s'; output='%s'."
EVALUATION = "Evaluation lesson: score=%.2f, pass=%s; weaknesses=%s; improvements=%s; anti_patterns=%s."
#: Fixed weights of a ranked evaluation.
SCORE, PASSED, NOT_PASSED, MOST_ANTI_PATTERNS, TEXT = 10.0, 3.0, 5.0, 3, 6.0
#: Keys that a request may state; a null or empty one takes all cases.
EXECUTION_KEYS, EVALUATION_KEYS = ("agent_type", "task_type", "channel_type"), ("agent_type", "task_type", "channel_type", "language")


def first_matching(cases: DataFrame, requests: DataFrame, keys: tuple[str, ...], order: list[Column], k: int) -> DataFrame:
    """(request_id, case: a case's columns): the first k cases that agree with each request in every key it states.

    Repeated requests count once, requests of one id that state different things are answered together.

    Which keys requests state together are at most 2^keys patterns.  Whatever a request states, only the first k cases of
    equal values of all keys can be among its first k: those alone, cut within each task before the shuffle, are dealt to
    the patterns in use, so that neither a frequent value nor a request for all is a hot group.
    """
    stated = [F.coalesce(F.length(c) > 0, F.lit(False)).alias(c) for c in keys]
    patterns = [tuple(r) for r in requests.select(*stated).distinct().collect()]
    if not patterns:
        return requests.select("request_id", F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in cases.schema)).alias("case")).limit(0)
    values = lambda p: F.array(*(F.coalesce(F.col(c), F.lit("")) if on else F.lit("") for c, on in zip(keys, p)))
    dealt = F.array(*(F.struct(F.lit("".join("01"[on] for on in p)).alias("pattern"), values(p).alias("values")) for p in patterns))
    whole = [F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in keys]
    few = rank.top_k(cases.select("*", *whole), [f"_{c}" for c in keys], order, k).drop(*(f"_{c}" for c in keys))
    rows = few.withColumn("_dealt", F.explode(dealt)).select("*", "_dealt.*").drop("_dealt")
    cut = rank.top_k(rows, ["pattern", "values"], order, k).select("pattern", "values", F.struct(*cases.columns).alias("case"))
    own = F.concat(*(F.when(F.length(c) > 0, "1").otherwise("0") for c in keys))
    asked = requests.select("request_id", own.alias("pattern"), F.array(*(F.coalesce(F.col(c), F.lit("")) for c in keys)).alias("values")).distinct()
    return asked.join(cut, ["pattern", "values"]).select("request_id", "case")


def _named(values: str, n: int) -> Column:
    """The first n of a list, or `none`."""
    said = F.array_join(F.slice(F.coalesce(F.col(values), F.array().cast("array<string>")), 1, n), ", ")
    return F.when(said == "", "none").otherwise(said)


def _quote(text: str) -> Column:
    return F.substring(stripped(F.coalesce(F.col(text), F.lit(""))), 1, QUOTED)


def _artifacts(rows: DataFrame, kind: str, case_id: str, text: Column, confidence: Column) -> DataFrame:
    namespace = f"craft_{kind}s"
    body = F.trim(text)
    rows = rows.select("request_id", F.col(case_id).alias("case_id"), F.lit(kind).alias("artifact_type"), F.lit(namespace).alias("namespace"), body.alias("text"), confidence.alias("confidence"), F.array(F.lit(kind), "agent_type", "task_type").alias("tags"))
    digest = F.substring(F.sha1(F.concat_ws("|", "artifact_type", "namespace", one_line(F.col("text")))), 1, 16)
    return rows.withColumn("artifact_id", F.concat_ws(":", F.lit("skill"), "artifact_type", digest))


def execution_lessons(cases: DataFrame, requests: DataFrame, k: int = CASES) -> DataFrame:
    """(request_id, case_id, artifact_type, namespace, text, confidence, tags, artifact_id): a lesson from each of the k
    newest cases that agree with a request (request_id and EXECUTION_KEYS), ties by case_id.

    cases: case_id, agent_type, task_type, channel_type, success, artifact_ids, request_text, output_text, created_at.
    Null texts are empty, a case without artifacts names none, a null `success` is a failure.
    """
    found = first_matching(cases, requests, EXECUTION_KEYS, [F.col("created_at").desc_nulls_last(), F.col("case_id")], k).select("request_id", "case.*")
    won = F.coalesce("success", F.lit(False))
    text = F.format_string(EXECUTION, F.coalesce("task_type", F.lit("")), F.when(won, "successful").otherwise("unsuccessful"), _named("artifact_ids", NAMED_ARTIFACTS), _quote("request_text"), _quote("output_text"))
    return _artifacts(found, "execution_lesson", "case_id", text, F.when(won, SUCCEEDED).otherwise(FAILED))


def evaluation_lessons(evaluations: DataFrame, requests: DataFrame, k: int = CASES) -> DataFrame:
    """The same from the k best evaluations that agree with a request (EVALUATION_KEYS too), newer ones first, ties by id.

    evaluations: evaluation_id, execution_id, EVALUATION_KEYS, overall, passed, strengths, weaknesses, improvements,
    anti_patterns (lists), edits (text), created_at.  The score is written with two decimals, halves upwards.
    """
    order = [F.col("overall").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("evaluation_id")]
    found = first_matching(evaluations, requests, EVALUATION_KEYS, order, k).select("request_id", "case.*")
    text = F.format_string(EVALUATION, F.coalesce("overall", F.lit(0.0)), F.when(F.col("passed"), "True").otherwise("False"), *(_named(c, NAMED_NOTES) for c in ("weaknesses", "improvements", "anti_patterns")))
    return _artifacts(found, "evaluation_lesson", "evaluation_id", text, F.lit(EVALUATED))


def _scored(rows: DataFrame, weak: Column, query: Column) -> DataFrame:
    overall, passed = F.coalesce("overall", F.lit(0.0)), F.coalesce("passed", F.lit(False))
    hits = F.least(F.coalesce(F.size("anti_patterns"), F.lit(0)), F.lit(MOST_ANTI_PATTERNS))
    hits = F.greatest(hits, F.lit(0))
    bad = (1.0 - overall) * SCORE + F.when(~passed, NOT_PASSED).otherwise(0.0) + hits
    good = overall * SCORE + F.when(passed, PASSED).otherwise(0.0)
    said = F.concat_ws(" ", *(F.concat_ws(" ", c) for c in ("strengths", "weaknesses", "improvements")), "edits", F.concat_ws(" ", "anti_patterns"))
    asked = token_set(query)
    share = F.size(F.array_intersect(asked, token_set(said))) / F.greatest(F.size(asked), F.lit(1))
    reasons = F.array_compact(F.array(F.when(weak & ~passed, "failed_case"), F.when(weak & (hits > 0), "anti_pattern_hits"), F.when(~weak & passed, "passed_case"), F.when(share > 0, "text_match")))
    return rows.select("request_id", "evaluation_id", F.round(F.when(weak, bad).otherwise(good) + share * TEXT, 6).alias("score"), reasons.alias("reasons"))


def _best(rows: DataFrame, k: int) -> DataFrame:
    return rank.top_k(rows, ["request_id"], [F.col("score").desc(), F.col("evaluation_id")], max(1, k))


def ranked_evaluations(evaluations: DataFrame, requests: DataFrame, k: int = 5, weak: bool = False) -> DataFrame:
    """(request_id, evaluation_id, score, reasons): the k best passed evaluations for each request, or, `weak`, the k
    that failed the worst, among the 3k (at least CASES) of the highest overall scores; ties by evaluation_id."""
    some = evaluations.where(F.coalesce("passed", F.lit(False)) == (not weak))
    order = [F.col("overall").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("evaluation_id")]
    found = first_matching(some, requests, EVALUATION_KEYS, order, max(3 * k, CASES)).select("request_id", "case.*")
    return _best(_scored(found, F.lit(weak), F.lit("")), k)


def evaluations_of_executions(evaluations: DataFrame, requests: DataFrame, k: int = 5) -> DataFrame:
    """The same for requests (request_id, execution_id, query): the evaluations of one execution, passed ones scored as
    good, failed ones as weak, and by the query's words that they say."""
    order = [F.col("overall").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("evaluation_id")]
    wanted = evaluations.join(requests.select("execution_id"), "execution_id", "left_semi")
    cut = rank.top_k(wanted, ["execution_id"], order, max(3 * k, CASES))
    found = requests.select("request_id", "execution_id", F.col("query").alias("_query")).distinct().join(cut, "execution_id")
    return _best(_scored(found, ~F.coalesce("passed", F.lit(False)), F.col("_query")), k)
