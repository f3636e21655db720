"""Distillation of skill notes (F19, F20, C12) and promotion of summaries (F39, C09); the checking SQL is written by hand.

The tables hold neither notes nor summaries, and their prose is invented, so each document and each message gets a lead
sentence by its number that cues one of the classes; documents in French stand for content, all others for craft.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators import distil, promote
from lorewell.sources.tables import read

NOTE_LEADS = (
    "Rubric: clarity; pace; 1-5 score.",
    "Template: {hook} {Body} {hook} end.",
    "Good: before: and after: the change!",
    "Avoid the mistake.",
    "Draft -> check → send.",
    "Warm tone, calm voice, plain words.",
    "Always cite the rule.",
    "Example without a verdict?",
)
SUMMARY_LEADS = (
    "The user said that user prefers short answers.",
    "Workflow: run checks then deploy.",
    "For today use the canary token.",
    "Note that - the project uses preferences.",
    "We concluded that the build was successful.",
    "Step 1 -> step 2.",
)


def _led(leads: tuple[str, ...], number: str) -> Column:
    lead = F.element_at(F.array(*map(F.lit, leads)), (F.col(number) % len(leads) + 1).cast("int"))
    return F.concat_ws(" ", lead, "text")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang") == "fr", "content").otherwise("craft")
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), kind.alias("source_kind"), _led(NOTE_LEADS, "doc_id").alias("text"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("chunk_index"), _led(SUMMARY_LEADS, "turn").alias("text"))


def f19_sentence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each class by document."""
    found = distil.distilled(notes(spark, sf_dir)).where("artifact_type <> 'raw_chunk'")
    return found.groupBy(F.col("ref").alias("doc_id"), F.col("artifact_type").alias("kind")).agg(F.count("*").alias("n"))


def f20_subtype_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the artifacts of each type say, as strings."""
    found = distil.detailed(distil.distilled(notes(spark, sf_dir)).where("artifact_type <> 'raw_chunk'"))
    lists = [F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) for c in ("slots", "criteria", "steps", "traits")]
    return found.select(F.col("ref").alias("doc_id"), "artifact_id", *lists, *(F.coalesce(c, F.lit("")).alias(c) for c in ("scale", "verdict")))


def c12_distilled_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = distil.distilled(notes(spark, sf_dir))
    return found.select(F.col("ref").alias("doc_id"), "artifact_type", "namespace", "artifact_id", "confidence", F.length("text").cast("long").alias("n_chars"))


def f39_durable_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = promote.durable_units(summaries(spark, sf_dir))
    return found.select("session_id", F.col("chunk_index").cast("long").alias("chunk_index"), "kind", "memory_subtype", F.round("confidence", 6).alias("confidence"), F.sha1("normalized_key").alias("key"))


def c09_promotion_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = promote.promoted_patterns(summaries(spark, sf_dir))
    sources = F.array_join(F.transform("sources", lambda c: c.cast("string")), ",").alias("sources")
    return found.select("session_id", "pattern_id", "kind", "memory_subtype", F.round("confidence", 6).alias("confidence"), "dedup_count", F.col("chunk_index").cast("long").alias("chunk_index"), sources)


QUERIES = {f.__name__: f for f in (f19_sentence_classes, f20_subtype_parsers, c12_distilled_artifacts, f39_durable_units, c09_promotion_bridge)}


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_ARTIFACTS = rf"""
WITH d AS (SELECT doc_id, coalesce(lang = 'fr', false) AS content, regexp_replace({_list(NOTE_LEADS)}[CAST(doc_id % 8 AS INT) + 1] || ' ' || coalesce(text, ''), '^\s+|\s+$', '', 'g') AS body FROM documents),
p AS (SELECT doc_id, regexp_replace(unnest(string_split_regex(regexp_replace(body, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')), '^\s+|\s+$', '', 'g') AS s FROM d WHERE NOT content),
c AS (SELECT doc_id, s, CASE WHEN regexp_matches(lower(s), 'rubric|score|criteria|1-5') THEN 'rubric'
 WHEN regexp_matches(lower(s), 'template|\[hook\]') OR (s LIKE '%{{%' AND s LIKE '%}}%') THEN 'template'
 WHEN regexp_matches(lower(s), '(before|after|good|bad):|example') THEN 'example'
 WHEN regexp_matches(lower(s), 'anti-pattern|mistake|avoid|don''t') THEN 'anti_pattern'
 WHEN regexp_matches(lower(s), '->|→|step |then |workflow') THEN 'workflow'
 WHEN regexp_matches(lower(s), 'tone|voice|style') THEN 'style_gist'
 WHEN regexp_matches(lower(s), 'principle|rule|should|always|never') THEN 'principle' END AS t FROM p WHERE s <> ''),
a AS (SELECT doc_id, 'raw_chunk' AS t, CASE WHEN content THEN 'content_books_raw' ELSE 'craft_raw' END AS ns, regexp_replace(substr(body, 1, 6000), '\s+$', '') AS s, 1.0 AS confidence FROM d WHERE body <> ''
 UNION ALL SELECT doc_id, t, CASE t WHEN 'anti_pattern' THEN 'craft_antipatterns' WHEN 'style_gist' THEN 'style_profiles' ELSE 'craft_' || t || 's' END, regexp_replace(substr(s, 1, 2000), '\s+$', ''), 0.75 FROM c WHERE t IS NOT NULL),
k AS (SELECT *, trim(regexp_replace(lower(s), '\s+', ' ', 'g')) AS key FROM a),
r AS (SELECT *, 'skill:' || t || ':' || substr(sha1(t || '|' || ns || '|' || key), 1, 16) AS artifact_id FROM k)"""

_LASTING = "NOT regexp_matches(lower(s), 'temporary|for today|today only|ephemeral|canary token|right now|this session only')"
_PROCEDURAL = "workflow|procedure|step | -> |→|then |run "
_STATED = f"{_LASTING} AND NOT regexp_matches(lower(s), '{_PROCEDURAL}')"
_PROPOSING = "user prefers|user likes|user wants|preference|project uses|project is|environment|constraint"


def _plain(x: str) -> str:
    for opening in ("the user said (that )?", "the user mentioned (that )?", "i remember (that )?", "we concluded (that )?", "it was concluded (that )?", "we learned (that )?", r"note that\s*"):
        x = rf"regexp_replace({x}, '(?i)^\s*{opening}', '')"
    return rf"trim(regexp_replace(regexp_replace({x}, '^\s*[:-]\s*', ''), '\s+', ' ', 'g'))"


_UNITS = rf"""
WITH m AS (SELECT conv_id, turn, row_number() OVER () AS rid, {_list(SUMMARY_LEADS)}[CAST(turn % 6 AS INT) + 1] || ' ' || coalesce(text, '') AS text FROM conversations),
e AS (SELECT rid, conv_id, turn, unnest(string_split_regex(text, '[.\n]+')) AS x, generate_subscripts(string_split_regex(text, '[.\n]+'), 1) AS i FROM m),
q AS (SELECT rid, conv_id, turn, i, {_plain('x')} AS s FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS nth FROM q WHERE s <> ''),
f AS (SELECT *, {_STATED} AND regexp_matches(lower(s), '{_PROPOSING}') AS claim, {_LASTING} AND regexp_matches(lower(s), '{_PROCEDURAL}|successful') AS rule, {_STATED} AS stated FROM n),
g AS (SELECT *, bool_or(claim) OVER (PARTITION BY rid) AS any_claim FROM f),
w AS (SELECT conv_id, turn, 'prescription' AS kind, s FROM g WHERE rule UNION ALL SELECT conv_id, turn, 'proposition', s FROM g WHERE claim OR (NOT any_claim AND nth = 1 AND stated)),
x AS (SELECT conv_id, turn, kind, regexp_replace(regexp_replace(replace(lower({_plain('s')}), '→', '->'), '\b(the user|user)\s+said\s+', 'user ', 'g'), '\bpreferences?\b', 'prefers', 'g') AS s FROM w),
y AS (SELECT conv_id, turn, kind, trim(regexp_replace(regexp_replace(s, '[^a-z0-9\s\->:/]', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM x),
u AS (SELECT conv_id, turn, kind, s, CASE WHEN kind = 'prescription' THEN CASE WHEN s LIKE '%->%' OR s LIKE '%then%' THEN 'workflow_pattern' ELSE 'procedure_pattern' END
 WHEN s LIKE '%user prefer%' OR s LIKE '%user like%' THEN 'profile_preference' ELSE 'stable_fact' END AS memory_subtype FROM y),
v AS (SELECT *, CAST(CASE memory_subtype WHEN 'workflow_pattern' THEN 0.85 WHEN 'procedure_pattern' THEN 0.8 WHEN 'profile_preference' THEN 0.76 ELSE 0.7 END AS DOUBLE) AS confidence, kind || ':' || s AS key FROM u)"""

_SPLIT = r"list_filter(list_transform(string_split(s, '{}'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')"
_SLOTS = r"list_sort(list_distinct(list_transform(list_filter(string_split_regex(replace(s, '{', ' {'), '\s+'), lambda w: w LIKE '{%}'), lambda w: lower(trim(substr(w, 2, length(w) - 2))))))"
_STEPS = "list_filter(list_transform(string_split(replace(s, '→', '->'), '->'), lambda p: trim(p, ' -')), lambda p: p <> '')"

ORACLE_SQL = {
    "f19_sentence_classes": f"{_ARTIFACTS} SELECT doc_id, t AS kind, count(*) AS n FROM r WHERE t <> 'raw_chunk' GROUP BY doc_id, t",
    "f20_subtype_parsers": f"""{_ARTIFACTS} SELECT doc_id, artifact_id, CASE WHEN t = 'template' THEN array_to_string({_SLOTS}, '|') ELSE '' END AS slots, CASE WHEN t = 'rubric' THEN array_to_string({_SPLIT.format(';')}, '|') ELSE '' END AS criteria,
 CASE WHEN t = 'workflow' THEN array_to_string({_STEPS}, '|') ELSE '' END AS steps, CASE WHEN t = 'style_gist' THEN array_to_string({_SPLIT.format(',')}, '|') ELSE '' END AS traits,
 CASE WHEN t <> 'rubric' THEN '' WHEN s LIKE '%1-5%' THEN '1-5' ELSE 'unspecified' END AS scale, CASE WHEN t <> 'example' THEN '' WHEN regexp_matches(key, 'good|after') THEN 'good' ELSE 'neutral' END AS verdict FROM r WHERE t <> 'raw_chunk'""",
    "c12_distilled_artifacts": f"{_ARTIFACTS} SELECT doc_id, t AS artifact_type, ns AS namespace, artifact_id, CAST(confidence AS DOUBLE) AS confidence, length(s) AS n_chars FROM r",
    "f39_durable_units": f"{_UNITS} SELECT conv_id AS session_id, CAST(turn AS BIGINT) AS chunk_index, kind, memory_subtype, confidence, sha1(key) AS key FROM v",
    "c09_promotion_bridge": f"""{_UNITS} SELECT conv_id AS session_id, 'prom:' || kind || ':' || substr(sha1(key), 1, 16) AS pattern_id, kind, memory_subtype, max(confidence) AS confidence, count(*) AS dedup_count,
 CAST(min(turn) AS BIGINT) AS chunk_index, array_to_string(list_sort(list(DISTINCT turn)), ',') AS sources FROM v GROUP BY conv_id, key, kind, memory_subtype""",
}
