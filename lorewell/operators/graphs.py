"""Categories and topics of hits as a graph: inferred from words, kept as edges, read back, and clusters made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.functions import lexicons as lx

#: A hint's score, how many hints a hit gets, and which hits are nodes: lane or type, name before the key.
HINT_BASE, HINT_STEP, MOST_HINTS = 0.3, 0.2, 3
BELONGS, HAS_TOPIC = "belongs_to_category", "has_topic"
SOURCES = (("promoted", "promoted:", "reasoning_pattern"), ("corpus", "corpus:", "corpus_chunk"), ("large_file", "large_file:", "large_file_chunk"))
TYPED_SOURCES = (("web_promoted_fact", "web_promoted"), ("web_evidence", "web_evidence"))
CLUSTER_TERMS, CLUSTER_NAMES = 4, 2


def hints(text: Column, lexicon: dict[str, tuple[str, ...]], most: int = MOST_HINTS) -> Column:
    """array<struct<name, score, matched>>: the categories whose words a text holds, best first, then by name."""
    if not lexicon:
        return F.expr("cast(array() as array<struct<name: string, score: double, matched: array<string>>>)")

    def found(low: Column) -> Column:
        each = [F.struct(F.lit(name).alias("name"), F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)).alias("matched")) for name, words in sorted(lexicon.items())]
        hit = F.filter(F.array(*each), lambda h: F.size(h["matched"]) > 0)
        scored = F.transform(hit, lambda h: F.struct((-F.least(F.lit(1.0), HINT_BASE + HINT_STEP * F.size(h["matched"]))).alias("minus"), h["name"].alias("name"), h["matched"].alias("matched")))
        return F.transform(F.slice(F.array_sort(scored), 1, most), lambda h: F.struct(h["name"].alias("name"), F.round(-h["minus"], 6).alias("score"), h["matched"].alias("matched")))

    return F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), found)[0]


def node_id(kind: Column, key: Column) -> Column:
    return F.concat(F.lit("node:"), F.substring(F.sha1(F.concat_ws("|", kind, key)), 1, 16))


def edge_id(source: Column, relation: str, target: Column) -> Column:
    return F.concat(F.lit("edge:"), F.substring(F.sha1(F.concat_ws("|", source, F.lit(relation), target)), 1, 18))


def source_of(hits: DataFrame) -> DataFrame:
    """hits (id, lane, memory_type) with node_type and node_key; both null for a hit that isn't a node."""
    kind, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lane, lead, name in SOURCES:
        own = (F.col("lane") == lane) & F.startswith("id", F.lit(lead))
        kind, key = F.when(own, name).otherwise(kind), F.when(own, F.substring("id", len(lead) + 1, 1 << 30)).otherwise(key)
    for typed, name in TYPED_SOURCES:
        own = F.col("memory_type") == typed
        kind, key = F.when(own, name).otherwise(kind), F.when(own, F.regexp_replace("id", "^[^:]*:", "")).otherwise(key)
    return hits.withColumns({"node_type": kind, "node_key": key})


def record_edges(hits: DataFrame, relation: str, lexicon: dict[str, tuple[str, ...]], now: Column) -> DataFrame:
    """(edge_id, source_id, relation, target_id, name, score, matched, created_at, updated_at): a hit's node to each name.

    Hits that aren't nodes, and texts without a word of the lexicon, have none; hits of one node write one edge, with the
    best score."""
    target = "category" if relation == BELONGS else "topic"
    rows = source_of(hits).where("node_type is not null").select(node_id(F.col("node_type"), F.col("node_key")).alias("source_id"), F.explode(hints(F.col("text"), lexicon)).alias("h"))
    rows = rows.withColumn("target_id", node_id(F.lit(target), F.col("h.name")))
    rows = rows.select(edge_id(F.col("source_id"), relation, F.col("target_id")).alias("edge_id"), "source_id", F.lit(relation).alias("relation"), "target_id", F.col("h.name").alias("name"), F.col("h.score").alias("score"), F.col("h.matched").alias("matched"))
    keep = ["source_id", "relation", "target_id", "name", "score", "matched"]
    return rows.groupBy("edge_id").agg(*(F.max_by(c, F.struct("score", "matched")).alias(c) for c in keep)).select("edge_id", *keep, now.alias("created_at"), now.alias("updated_at"))


def merged_edges(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The edges after new ones are written: what a new edge says, but the time at which it was first made."""
    if old is None:
        return new
    at = F.col("updated_at")
    return old.unionByName(new).groupBy("edge_id").agg(*((F.min(c) if c == "created_at" else F.max_by(c, at)).alias(c) for c in new.columns if c != "edge_id")).select(*new.columns)


def read_back(hits: DataFrame, edges: DataFrame, most: int = MOST_HINTS) -> DataFrame:
    """hits with categories and topics, array<struct<name, score>> as the graph has them: best first, then by edge."""
    out = source_of(hits).withColumn("_node", node_id(F.col("node_type"), F.col("node_key")))
    for column, relation in (("categories", BELONGS), ("topics", HAS_TOPIC)):
        best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "edge_id", "name", "score")))
        own = edges.where(F.col("relation") == relation).groupBy("source_id").agg(F.transform(F.slice(best, 1, most), lambda e: F.struct(e["name"].alias("name"), e["score"].alias("score"))).alias(column))
        out = out.join(own.withColumnRenamed("source_id", "_node"), "_node", "left").withColumn(column, F.coalesce(column, F.expr("cast(array() as array<struct<name: string, score: double>>)")))
    return out.drop("_node", "node_type", "node_key")


def cluster_id(lane: Column, kind: Column, topics: Column, categories: Column, text: Column) -> Column:
    """A hit's cluster: its lane and type, the first names of its topics and categories, and the first words of its text."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: ~w.isin(*lx.CLUSTER_STOPWORDS))
    terms = F.slice(F.array_sort(F.array_distinct(words)), 1, CLUSTER_TERMS)
    terms = F.when(F.size(terms) > 0, terms).otherwise(F.array(F.lit("uncategorized")))
    names = [F.slice(F.array_sort(F.transform(c, lambda x: x["name"])), 1, CLUSTER_NAMES) for c in (topics, categories)]
    return F.concat(F.lit("cl:"), F.substring(F.sha1(F.array_join(F.concat(F.array(lane, kind), *names, terms), "|")), 1, 10))


def annotated(hits: DataFrame, categories: dict = lx.CATEGORIES, topics: dict = lx.TOPICS, edges: DataFrame | None = None, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """hits (id, lane, memory_type, text) with categories, topics and cluster_id, which replaces one that is there; and the
    edges as they are then."""
    now = F.lit(0).cast("long") if now is None else now
    merged = merged_edges(edges, record_edges(hits, BELONGS, categories, now).unionByName(record_edges(hits, HAS_TOPIC, topics, now)))
    out = read_back(hits, merged)
    return out.withColumn("cluster_id", cluster_id(F.col("lane"), F.col("memory_type"), F.col("topics"), F.col("categories"), F.col("text"))), merged
