"""What a query is to be looked up with: intent, lanes, risk, variants, topics and probes, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import lexicons as lx

from .discovery import ROLES

#: Bounds of a plan.
VARIANTS, TOPICS, PROBES, MOCK_PROBES = 4, 6, 4, 2
LEAST_PART, LEAST_TOPIC = 8, 4


def _says(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def _first(cases: list[tuple[Column, Column]], other: Column) -> Column:
    """The value of the first condition that holds."""
    out = other
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _by_intent(values: dict[str, tuple[str, ...]]) -> Column:
    return _first([(F.col("intent_family") == k, _texts(v)) for k, v in values.items()], _texts(values[lx.OTHER_INTENT]))


def _probe(kind: str, role: Column, purpose: str, priority: Column) -> Column:
    asked = F.when(F.col("query") == "", "(empty query)").otherwise(F.col("query"))
    prompt = F.concat(F.lit("["), role, F.lit(f"] {purpose} Query: "), asked, F.lit(". Target lanes: "), F.array_join("expected_lanes", ", "), F.lit("."))
    return F.struct(F.lit(kind).alias("kind"), role.alias("role"), F.lit(purpose).alias("purpose"), priority.cast("int").alias("priority"), prompt.alias("prompt"))


def _role_probes(most: int) -> Column:
    return F.transform(F.slice(_by_intent(ROLES), 1, most), lambda role, i: _probe("role", role, lx.ROLE_PURPOSE, i + 1))


def _fixed_probes() -> Column:
    """Contradiction and novelty probes, where the intent or the web asks for them."""
    made = []
    for kind, role, priority, purpose, intents, web in lx.PLAN_PROBES:
        fits = F.col("intent_family").isin(*intents) if intents else F.lit(True)
        fits = fits & F.col("web_sensitive") if web else fits
        made.append(F.when(fits, _probe(kind, F.lit(role), purpose, F.lit(priority))))
    return F.array_compact(F.array(*made))


def _variants(query: Column) -> Column:
    compact = F.trim(F.regexp_replace(F.regexp_replace(F.lower(query), r"[^a-z0-9\s]+", " "), r"\s+", " "))
    parts = F.filter(F.transform(F.split(compact, " and "), F.trim), lambda p: F.length(p) >= LEAST_PART)
    more = F.concat(F.array(compact), F.when(F.contains(compact, F.lit(" and ")), parts).otherwise(_texts(())))
    more = F.filter(F.array_distinct(more), lambda v: (v != "") & (v != F.lower(query)))
    return F.when(query == "", _texts(())).otherwise(F.slice(F.concat(F.array(query), more), 1, VARIANTS))


def discovery_plans(queries: DataFrame, mock: bool = False) -> DataFrame:
    """A plan for each row of queries (query_id, query, hinted_intent, local_evidence_count, available_lanes): query_id,
    query (white space made single), intent_family, web_sensitive, risk_mode, discovery_mode, expected_lanes,
    query_variants, adjacent_topics, probes (kind, role, purpose, priority, prompt), notes.

    A hint that names an intent decides it, any other is ignored.  available_lanes, where not null, restricts the lanes
    unless nothing would remain.  A null query is an empty one: no variants or topics, the last intent.  `mock` gives the
    short plan of fixed notes.  Row by row: nothing is shuffled, repeated rows each get their plan.
    """
    query = F.trim(F.regexp_replace(F.coalesce("query", F.lit("")), r"(?U)\s+", " "))
    rows = queries.select("query_id", query.alias("query"), "hinted_intent", F.coalesce("local_evidence_count", F.lit(0)).alias("evidence"), "available_lanes")
    low = F.lower("query")
    told = _first([(_says(low, words), F.lit(name)) for name, words in lx.INTENTS], F.lit(lx.OTHER_INTENT))
    intent = F.when(F.col("hinted_intent").isin(*lx.PLAN_LANES), F.col("hinted_intent")).otherwise(told)
    rows = rows.withColumns({"intent_family": intent, "web_sensitive": _says(low, lx.PLAN_WEB_WORDS)})
    lanes = F.concat(_by_intent(lx.PLAN_LANES), F.when(F.col("web_sensitive"), _texts(("web",))).otherwise(_texts(())))
    rows = rows.withColumn("lanes", lanes).withColumn("allowed", F.array_intersect("lanes", "available_lanes"))
    rows = rows.withColumn("expected_lanes", F.when(F.size("allowed") > 0, F.col("allowed")).otherwise(F.col("lanes")))
    if mock:
        notes, risk = _texts(("mock-controller-mode", "deterministic-no-llm")), F.lit("mock")
        mode = F.when(F.col("intent_family") == "investigative", "passive").otherwise("off")
        variants = F.array(F.when(F.col("query") == "", "(empty query)").otherwise(F.col("query")), F.concat(F.lit("mock:"), "intent_family"))
        topics, probes = _texts(("mock-topic-a", "mock-topic-b")), _role_probes(MOCK_PROBES)
    else:
        evidence = F.col("evidence")
        active = ((F.col("intent_family") == "investigative") & (evidence <= 0)) | (F.col("web_sensitive") & (evidence < 2))
        mode = _first([(F.col("intent_family").isin(*lx.UNDISCOVERED), F.lit("off")), (active, F.lit("active"))], F.lit("passive"))
        risk = _first([(_says(low, words), F.lit(name)) for name, words in lx.RISKS], F.lit("normal"))
        variants = _variants(F.col("query"))
        tokens = F.filter(F.split(low, "[^a-z0-9]+"), lambda t: (F.length(t) >= LEAST_TOPIC) & ~t.isin(*lx.PLAN_STOPWORDS))
        topics, probes = F.slice(F.array_distinct(tokens), 1, TOPICS), F.concat(_role_probes(PROBES), _fixed_probes())
        hinted = F.when(F.length("hinted_intent") > 0, F.lit("intent hint considered"))
        notes = F.concat(_texts(lx.PLAN_NOTES), F.array_compact(F.array(F.when(F.col("web_sensitive"), F.lit(lx.WEB_NOTE)), hinted)))
    return rows.select("query_id", "query", "intent_family", "web_sensitive", risk.alias("risk_mode"), mode.alias("discovery_mode"), "expected_lanes", variants.alias("query_variants"), topics.alias("adjacent_topics"), probes.alias("probes"), notes.alias("notes"))
