"""Promotion of session summaries: sentences become durable units, equal units of a session one pattern."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Openings that only say who said it, cues of sentences, confidence by kind and what a subtype adds.
SPEECH_ACTS = (
    r"^\s*the user said (that )?",
    r"^\s*the user mentioned (that )?",
    r"^\s*i remember (that )?",
    r"^\s*we concluded (that )?",
    r"^\s*it was concluded (that )?",
    r"^\s*we learned (that )?",
    r"^\s*note that\s*",
)
EPHEMERAL = ("temporary", "for today", "today only", "ephemeral", "canary token", "right now", "this session only")
PROCEDURAL = ("workflow", "procedure", "step ", " -> ", "→", "then ", "run ")
PRESCRIBING = (*PROCEDURAL, "successful")
PROPOSING = ("user prefers", "user likes", "user wants", "preference", "project uses", "project is", "environment", "constraint")
PROPOSITION, PROFILE_BONUS = 0.7, 0.06
PRESCRIPTION, WORKFLOW_BONUS = 0.8, 0.05


def without_speech_act(x: Column) -> Column:
    for opening in SPEECH_ACTS:
        x = F.regexp_replace(x, "(?i)" + opening, "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*[:\-]\s*", ""), r"\s+", " "))


def canonical(x: Column) -> Column:
    x = F.replace(F.lower(without_speech_act(x)), F.lit("→"), F.lit("->"))
    x = F.regexp_replace(F.regexp_replace(x, r"\b(the user|user)\s+said\s+", "user "), r"\bpreferences?\b", "prefers")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9\s\-\>:/]", " "), r"\s+", " "))


def _has(s: Column, cues: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(s), F.lit(c)) for c in cues))


def durable_units(summaries: DataFrame) -> DataFrame:
    """Units of summaries (session_id, chunk_index, text): session_id, chunk_index, kind, memory_subtype, canonical_text,
    normalized_key, confidence.

    A lasting sentence that prescribes gives a prescription; one that proposes, and isn't procedural, a proposition.  A
    summary without a proposition gives its first sentence as one, if that is lasting and not procedural.  Null and blank
    texts give none; repeated sentences and rows give repeated units.
    """
    said = F.filter(F.transform(F.split("text", r"[.\n]+"), without_speech_act), lambda s: s != "")
    rows = summaries.select("session_id", "chunk_index", said.alias("said"))
    stated = lambda s: ~_has(s, EPHEMERAL) & ~_has(s, PROCEDURAL)
    rows = rows.select("session_id", "chunk_index", "said", F.filter("said", lambda s: ~_has(s, EPHEMERAL) & _has(s, PRESCRIBING)).alias("rules"), F.filter("said", lambda s: stated(s) & _has(s, PROPOSING)).alias("claims"))
    claims = F.when(F.size("claims") > 0, F.col("claims")).otherwise(F.filter(F.slice("said", 1, 1), stated))
    unit = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), canonical(s).alias("text"))
    rows = rows.select("session_id", "chunk_index", F.explode(F.concat(F.transform("rules", unit("prescription")), F.transform(claims, unit("proposition")))).alias("u"))
    rows = rows.select("session_id", "chunk_index", "u.kind", F.col("u.text").alias("canonical_text"))
    text = F.col("canonical_text")
    rule = F.when(F.contains(text, F.lit("->")) | F.contains(text, F.lit("then")), "workflow_pattern").otherwise("procedure_pattern")
    claim = F.when(F.contains(text, F.lit("user prefer")) | F.contains(text, F.lit("user like")), "profile_preference").otherwise("stable_fact")
    rows = rows.withColumn("memory_subtype", F.when(F.col("kind") == "prescription", rule).otherwise(claim))
    bonus = F.when(F.col("memory_subtype") == "workflow_pattern", WORKFLOW_BONUS).when(F.col("memory_subtype") == "profile_preference", PROFILE_BONUS).otherwise(0.0)
    base = F.when(F.col("kind") == "prescription", PRESCRIPTION).otherwise(PROPOSITION)
    return rows.withColumn("normalized_key", F.concat_ws(":", "kind", "canonical_text")).withColumn("confidence", base + bonus)


def promoted_patterns(summaries: DataFrame) -> DataFrame:
    """One pattern for each session and key: session_id, pattern_id, kind, memory_subtype, canonical_text, confidence,
    dedup_count, chunk_index (of its first unit), sources (the chunks it comes from, ascending).

    Equal units are counted with partial sums before the one shuffle by (session, key)."""
    units = durable_units(summaries)
    out = units.groupBy("session_id", "normalized_key", "kind", "memory_subtype", "canonical_text").agg(F.max("confidence").alias("confidence"), F.count("*").alias("dedup_count"), F.min("chunk_index").alias("chunk_index"), F.array_sort(F.collect_set("chunk_index")).alias("sources"))
    return out.withColumn("pattern_id", F.concat_ws(":", F.lit("prom"), "kind", F.substring(F.sha1("normalized_key"), 1, 16)))
