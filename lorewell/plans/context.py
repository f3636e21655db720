"""Compound queries: context assembly, reasoning folds, chunking, streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.functions import lexicons as lx
from lorewell.functions.dialect import Spark
from lorewell.operators import chunk, discovery, fold, graphs, lanes, rank, select
from lorewell.sources.tables import read, register
from lorewell.streaming import ingest

from . import relational

#: Hits of a lane for a query; both lanes fill them up with rows that share no word.
CORPUS_HITS, LARGE_FILES = 8, 6
#: Categories and topics whose words occur in the invented prose.
CATEGORIES = {"c_joined": ("with", "and"), "c_near": ("this", "that"), "c_far": ("from", "than")}
TOPICS = {"t_that": ("that", "than"), "t_with": ("with", "this"), "t_from": ("from", "ther", "thon")}


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, intent): the benchmark's texts and the intent that each is routed to."""
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return queries.withColumn("intent", F.expr(relational.intent(Spark(), "lower(query)")))


def large_file_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, text): documents over 5,000 characters as large files, by an excerpt, else where they come from."""
    excerpt = F.coalesce(F.nullif(F.substring("text", 1, 120), F.lit("")), "source", F.lit("large file"))
    return documents.where("n_chars > 5000").select("doc_id", excerpt.alias("text"))


def lane_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the lanes that each query's intent is routed to, as one table; a query is asked in the session of its id.

    Each lane is cut to its best few before it is joined with texts again."""
    register(spark, sf_dir)
    from . import retrieval  # which takes its queries from here

    lane = lambda name: getattr(retrieval, name)(spark, sf_dir)
    queries = asked(spark, sf_dir)
    messages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), "text")
    docs = read(spark, sf_dir, "documents")
    signals = ("recency_score", "freshness_score", "novelty_score")
    scores = ("lexical_score", "semantic_score", "trust_score", *signals)

    def hits(rows: DataFrame, name: str, kind: str, key: list[str], **fixed: float) -> DataFrame:
        """One shape for all lanes; a signal that a lane doesn't know is 0."""
        ident = F.concat_ws(":", F.col("lane") if name == "" else F.lit(name), *(F.col(c).cast("string") for c in key))
        known = [F.col(c) if c in rows.columns else F.lit(fixed.get(c, 0.6 if c == "trust_score" else 0.0)).alias(c) for c in scores]
        must = F.col("must_include") if "must_include" in rows.columns else F.lit(False).alias("must_include")
        return rows.select("query_id", F.col("lane") if name == "" else F.lit(name).alias("lane"), ident.alias("id"), F.lit(kind).alias("memory_type"), "text", *known, must)

    sessions = queries.withColumn("session_id", F.col("query_id"))
    parts = [hits(lanes.episodic_lane(sessions, messages), "", "episodic_raw", ["session_id", "message_id"])]
    for name, plan in (("lexical", "l01_lexical_lane"), ("semantic", "l02_semantic_lane")):
        parts.append(hits(lane(plan).join(messages, ["session_id", "message_id"]), name, "message", ["session_id", "message_id"]))
    parts.append(hits(lanes.overlap_lane(queries, docs.select("doc_id", "text"), "corpus:", CORPUS_HITS), "corpus", "corpus_chunk", ["doc_id"], **lanes.CORPUS))
    promoted = lane("l04_promoted_lane").withColumnRenamed("fact_id", "doc_id").join(docs.select("doc_id", "text"), "doc_id").join(queries.select("query_id", "intent"), "query_id")
    likely = F.when(F.col("intent").isin("memory_summary", "planning"), 0.45).otherwise(0.25)
    parts.append(hits(promoted.withColumn("semantic_score", likely), "promoted", "promoted_fact", ["doc_id"]))
    parts.append(hits(lanes.overlap_lane(queries, large_file_texts(docs), "large_file:", LARGE_FILES), "large_file", "large_file_excerpt", ["doc_id"], **lanes.LARGE_FILE))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    index = F.lit(0)
    route = F.when(F.col("lane") == "fresh_tail", "episodic").otherwise(F.col("lane"))
    for name, routed in lx.LANES.items():
        index = F.when(F.col("intent") == name, F.array_position(F.array(*map(F.lit, routed)), route)).otherwise(index)
    out = out.join(queries, "query_id").withColumn("lane_index", index - 1).where("lane_index >= 0")
    clusters = graphs.cluster_id(F.col("lane"), F.col("memory_type"), graphs.hints(F.col("text"), TOPICS), graphs.hints(F.col("text"), CATEGORIES), F.col("text"))
    tokens = F.greatest(F.lit(1), F.floor((F.length("text") + 3) / 4)).cast("int")
    return out.withColumn("ord", F.xxhash64("id")).withColumn("cluster_id", clusters).withColumn("tokens", tokens)


def u08_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rerank(lane_hits(spark, sf_dir)).select("query_id", "id", "lane", "final_score", F.col("place").cast("long").alias("place"), "applied")


def c02_assemble_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = rank.rerank(lane_hits(spark, sf_dir)).withColumn("ord", F.col("place"))
    zero = [F.lit(0.0).alias("contradiction_risk")]
    none = [F.lit(None).cast("string").alias(c) for c in ("claim_key", "claim_value")]
    hits = hits.select("query_id", "ord", "id", "lane", "memory_type", "text", "tokens", "lexical_score", "semantic_score", "trust_score", "recency_score", "freshness_score", "novelty_score", "cluster_id", "intent", *zero, *none, "must_include", (~F.col("must_include")).alias("compressible"), F.lit(True).alias("has_provenance"))
    return select.select_context(hits)


def document_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hits whose scores, lanes and claims are told by their number, for operators that take hits as they are;
    a source is a query, in the order of its documents."""
    i, intents = F.col("doc_id"), F.array(*map(F.lit, lx.WEIGHTS))
    part = lambda n, k: ((i + k) % n / n).alias
    lane = F.element_at(F.array(*map(F.lit, ("semantic", "corpus", "episodic", "fresh_tail", "promoted", "session_summary", "architecture"))), (i % 7 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("corpus_chunk", "summary", "promoted_fact", "episodic_raw", "architecture_note"))), (i % 5 + 1).cast("int"))
    number = F.regexp_extract("source", "[0-9]+", 0).cast("long")
    scores = [part(n, k)(c) for c, n, k in (("lexical_score", 11, 0), ("semantic_score", 13, 1), ("recency_score", 3, 2), ("freshness_score", 4, 3), ("trust_score", 9, 4), ("novelty_score", 10, 5), ("contradiction_risk", 21, 6))]
    return read(spark, sf_dir, "documents").select(number.alias("query_id"), i.alias("ord"), F.concat(F.lit("h"), F.lpad(i.cast("string"), 12, "0")).alias("id"), lane.alias("lane"), kind.alias("memory_type"), "text", F.greatest(F.lit(1), F.floor((F.length("text") + 3) / 4)).cast("int").alias("tokens"), *scores, F.concat(F.lit("k"), (i % 6).cast("string")).alias("cluster_id"), F.concat(F.lit("claim"), (i % 50).cast("string")).alias("claim_key"), F.coalesce("lang", F.lit("")).alias("claim_value"), F.lit(False).alias("must_include"), (i % 8 != 0).alias("compressible"), (i % 6 != 0).alias("has_provenance"), F.element_at(intents, (number % F.size(intents) + 1).cast("int")).alias("intent"))


def c01_pruned_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of up to 600 tokens, pruned by source."""
    rows = document_hits(spark, sf_dir).where("tokens <= 600 and query_id is not null")
    return select.pruned_hits(rows).select("query_id", "id", "lane", F.col("tokens").cast("long").alias("tokens"), F.sha1("text").alias("text"))


def c03_fixed_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_hits(spark, sf_dir).where("query_id is not null")
    return rows.select("id", "intent", F.round(select.by_intent(select.intent_fit), 6).alias("intent_fit"), F.round(select.by_intent(select.fixed_utility), 6).alias("utility"))


def j10_conflict_with_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document is selected; the others are candidates of the same source."""
    rows = document_hits(spark, sf_dir).select("query_id", "ord", "id", "claim_key", "claim_value")
    return select.against_selected(rows.where("ord % 7 <> 0").drop("ord"), rows.where("ord % 7 = 0")).select("id", "conflict")


def w01_lane_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_hits(spark, sf_dir).withColumn("score", F.col("lexical_score") + F.col("semantic_score"))
    best = rank.top_k(rows, ["query_id", "lane"], [F.round("score", 9).desc(), F.col("id")], 3)
    return best.select("query_id", "lane", "id", F.round("score", 6).alias("score"))


def c06_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's tokens and hits by lane, and why hits were dropped."""
    chosen = c02_assemble_context(spark, sf_dir)
    return chosen.groupBy("query_id", "lane").agg(F.count_if(F.col("status") == "selected").alias("selected"), F.sum(F.when(F.col("status") == "selected", F.col("tokens")).otherwise(0)).alias("tokens"), F.count_if(F.col("reason") == "budget_or_lane_cap").alias("capped"), F.count_if(F.col("reason") == "compatibility_conflict").alias("conflicts"))


def c10_near_reasoning_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return fold.link_near(fold.fold_exact(fold.fingerprints(rows)))


def c15_aligned_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("txt").alias("kind"), "text")
    return chunk.chunk(docs).select("document_id", "chunk_index", "char_start", "char_end", "overlap_before", "overlap_after", F.sha1("text").alias("chunk"))


def c15_corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown with three headings, and every third as code with two symbols."""
    docs = read(spark, sf_dir, "documents")
    plain, number = F.regexp_replace(F.coalesce("text", F.lit("")), r"[#\s]", " "), F.col("doc_id").cast("string")
    part = lambda a, n: F.substring(plain, a, n)
    md = F.concat(F.lit("# Doc "), number, F.lit("\n"), part(1, 200), F.lit("\n\n## Part\n"), part(201, 200), F.lit("\n\n# End\n"), part(401, 100), F.lit("."))
    code = F.concat(F.lit("import os\n\ndef first():\n    return '"), part(1, 50), F.lit("'\n\nclass Second:\n    x = 1\n"))
    is_code = F.col("doc_id") % 3 == 0
    rows = docs.select(F.concat(F.lit("d"), number).alias("document_id"), F.when(is_code, "a/b.py").otherwise("a/b.md").alias("source_path"), F.when(is_code, code).otherwise(md).alias("text"))
    whole = [F.col(c).cast("long").alias(c) for c in ("chunk_index", "char_start", "char_end", "line_start", "line_end", "overlap_before", "overlap_after")]
    return chunk.corpus_chunks(rows).select("document_id", "chunk_id", "source_type", "strategy", "title", "path", F.col("level").cast("string").alias("level"), *whole)


def c04_bounded_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roles of each query's intent, and what the graph of its hits suggests."""
    path = ingest.shared_path(spark, "hits")  # read by the graph and by the probes
    lane_hits(spark, sf_dir).write.parquet(path)
    hits, _ = graphs.annotated(spark.read.parquet(path), CATEGORIES, TOPICS)
    return discovery.discover(hits)


def u06_category_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as corpus hits: written to the graph twice, read back, and put into clusters."""
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("corpus:"), F.col("doc_id").cast("string")).alias("id"), F.lit("corpus").alias("lane"), F.lit("corpus_chunk").alias("memory_type"), "text", "doc_id")
    _, old = graphs.annotated(docs, CATEGORIES, {}, now=F.lit(1).cast("long"))
    hits, edges = graphs.annotated(docs, CATEGORIES, TOPICS, old, F.lit(2).cast("long"))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["name"], F.format_number(x["score"], 1))), ",").alias(c)
    return hits.select("doc_id", told("categories"), told("topics"), "cluster_id")


def t01_stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.upserted_messages(spark, f"{sf_dir}/conversations.parquet")


def t02_stream_mirror_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.mirrored_turns(spark, f"{sf_dir}/conversations.parquet")


def t04_stream_fresh_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.rolling_tails(spark, f"{sf_dir}/conversations.parquet")


QUERIES = {f.__name__: f for f in (c15_corpus_chunks, c01_pruned_hits, c03_fixed_utility, j10_conflict_with_selected, w01_lane_top_k, u06_category_graph, u08_rerank, c02_assemble_context, c04_bounded_discovery, c06_explanation, c10_near_reasoning_links, c15_aligned_chunks, t01_stream_upsert, t02_stream_mirror_turns, t04_stream_fresh_tail)}



def _hints_sql(lexicon: dict[str, tuple[str, ...]], kind: str, relation: str) -> str:
    """A row for each document and name: its score, and the edge that orders equal ones."""
    n = {name: " + ".join(f"contains(low, '{w}')::INT" for w in words) for name, words in lexicon.items()}
    return " UNION ALL ".join(f"SELECT doc_id, '{name}' AS name, least(1.0, 0.3 + 0.2 * ({x})) AS score, sha1(source || '|{relation}|' || 'node:' || substr(sha1('{kind}|{name}'), 1, 16)) AS edge FROM d WHERE {x} > 0" for name, x in n.items())


_CLUSTER_STOPS = ", ".join(f"'{w}'" for w in lx.CLUSTER_STOPWORDS)

_HITS = f"""h AS (SELECT doc_id, nullif(regexp_extract(source, '[0-9]+'), '')::BIGINT AS query_id, 'h' || lpad(doc_id::VARCHAR, 12, '0') AS id, ['semantic', 'corpus', 'episodic', 'fresh_tail', 'promoted', 'session_summary', 'architecture'][doc_id % 7 + 1] AS lane,
 ['corpus_chunk', 'summary', 'promoted_fact', 'episodic_raw', 'architecture_note'][doc_id % 5 + 1] AS kind, doc_id % 11 / 11 AS lex, (doc_id + 1) % 13 / 13 AS sem, (doc_id + 2) % 3 / 3 AS rec, (doc_id + 3) % 4 / 4 AS fresh, (doc_id + 4) % 9 / 9 AS trust, (doc_id + 5) % 10 / 10 AS nov, (doc_id + 6) % 21 / 21 AS risk,
 'claim' || doc_id % 50 AS k, coalesce(lang, '') AS v, doc_id % 6 <> 0 AS prov FROM documents), t AS (SELECT *, [{", ".join(f"'{i}'" for i in lx.WEIGHTS)}][query_id % {len(lx.WEIGHTS)} + 1] AS intent FROM h WHERE query_id IS NOT NULL)"""
_WEIGHED = ", ".join(f"('{i}', {', '.join(map(str, w))})" for i, w in lx.WEIGHTS.items())

ORACLE_SQL = {
    "c15_corpus_chunks": """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents),
m AS (SELECT doc_id, length('# Doc ' || doc_id) + 1 + least(n, 200) + 2 AS a, 8 + greatest(least(n - 200, 200), 0) + 2 AS b, 6 + greatest(least(n - 400, 100), 0) + 1 AS c FROM d WHERE doc_id % 3 <> 0),
s AS (SELECT doc_id, 0 AS i, 'Doc ' || doc_id AS title, 'Doc ' || doc_id AS path, 1 AS level, 0 AS x, a AS y, 1 AS l, 4 AS r FROM m UNION ALL SELECT doc_id, 1, 'Part', 'Doc ' || doc_id || ' > Part', 2, a, a + b, 4, 7 FROM m UNION ALL SELECT doc_id, 2, 'End', 'End', 1, a + b, a + b + c, 7, 8 FROM m),
k AS (SELECT doc_id, least(n, 50) AS t FROM d WHERE doc_id % 3 = 0),
p AS (SELECT doc_id, 0 AS i, 'module_preamble' AS title, 0 AS x, 10 AS y, 1 AS l, 2 AS r FROM k UNION ALL SELECT doc_id, 1, 'first', 10, 10 + 14 + 12 + t + 2, 2, 5 FROM k UNION ALL SELECT doc_id, 2, 'Second', 38 + t, 38 + t + 1 + 14 + 10, 5, 8 FROM k)
SELECT 'd' || doc_id AS document_id, 'd' || doc_id || '_chunk_000' || i AS chunk_id, 'markdown' AS source_type, 'markdown_section' AS strategy, title, path, i::BIGINT AS chunk_index, level::VARCHAR AS level, x::BIGINT AS char_start, y::BIGINT AS char_end, l::BIGINT AS line_start, r::BIGINT AS line_end, 0::BIGINT AS overlap_before, 0::BIGINT AS overlap_after FROM s
UNION ALL SELECT 'd' || doc_id, 'd' || doc_id || '_chunk_000' || i, 'code', 'code_symbol', title, title, i, NULL, x, y, l, r, 0, 0 FROM p""",
    "c03_fixed_utility": f"""WITH {_HITS}, w(intent, rel, pv, rc, fr, nv, ft, rd, cn) AS (VALUES {_WEIGHED}),
f AS (SELECT *, CASE intent WHEN 'exact_recall' THEN CASE WHEN lane IN ('episodic', 'fresh_tail') THEN 1.0 WHEN kind = 'summary' THEN 0.1 ELSE 0.2 END
 WHEN 'memory_summary' THEN CASE WHEN kind IN ('summary', 'promoted_fact', 'architecture_note') THEN 1.0 WHEN lane = 'episodic' THEN 0.35 ELSE 0.5 END
 WHEN 'architecture_explanation' THEN CASE WHEN lane = 'architecture' THEN 1.0 ELSE 0.2 END
 WHEN 'corpus_overview' THEN CASE WHEN lane IN ('corpus', 'large_file') THEN 1.0 WHEN lane = 'fresh_tail' THEN 0.35 ELSE 0.2 END
 WHEN 'planning' THEN CASE lane WHEN 'fresh_tail' THEN 1.0 WHEN 'episodic' THEN 1.0 WHEN 'lexical' THEN 0.8 WHEN 'promoted' THEN 0.65 WHEN 'session_summary' THEN 0.25 ELSE 0.35 END
 ELSE CASE WHEN lane IN ('corpus', 'large_file', 'promoted', 'episodic') THEN 0.8 ELSE 0.45 END END AS fit FROM t)
SELECT id, f.intent, round(fit::DOUBLE, 6) AS intent_fit, round(CAST(rel * (lex + sem) / 2 + pv * CASE WHEN prov THEN 1.0 ELSE 0.2 END + rc * rec + fr * (fresh + trust) / 2 + nv * nov + ft * fit - cn * risk AS DOUBLE), 6) AS utility FROM f JOIN w ON w.intent = f.intent""",
    "j10_conflict_with_selected": f"""WITH {_HITS} SELECT a.id, EXISTS (SELECT 1 FROM h b WHERE b.doc_id % 7 = 0 AND b.query_id = a.query_id AND b.k = a.k AND b.v <> '' AND a.v <> '' AND b.v <> a.v) AS conflict FROM h a WHERE a.doc_id % 7 <> 0""",
    "w01_lane_top_k": f"""WITH {_HITS} SELECT query_id, lane, id, round(lex + sem, 6) AS score FROM h QUALIFY row_number() OVER (PARTITION BY query_id, lane ORDER BY round(lex + sem, 9) DESC, id) <= 3""",
    "u06_category_graph": f"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, 'node:' || substr(sha1('corpus_chunk|' || doc_id), 1, 16) AS source FROM documents),
c AS ({_hints_sql(CATEGORIES, "category", graphs.BELONGS)}), t AS ({_hints_sql(TOPICS, "topic", graphs.HAS_TOPIC)}),
cs AS (SELECT doc_id, string_agg(name || ':' || printf('%.1f', score), ',' ORDER BY score DESC, edge) AS told, list_sort(list(name))[:2] AS names FROM c GROUP BY doc_id),
ts AS (SELECT doc_id, string_agg(name || ':' || printf('%.1f', score), ',' ORDER BY score DESC, edge) AS told, list_sort(list(name))[:2] AS names FROM t GROUP BY doc_id),
w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(low, '[a-z0-9_]+'), lambda x: x NOT IN ({_CLUSTER_STOPS}))))[:4] AS terms FROM d)
SELECT w.doc_id, coalesce(cs.told, '') AS categories, coalesce(ts.told, '') AS topics,
 'cl:' || substr(sha1(array_to_string(['corpus', 'corpus_chunk'] || coalesce(ts.names, []) || coalesce(cs.names, []) || CASE WHEN len(terms) > 0 THEN terms ELSE ['uncategorized'] END, '|')), 1, 10) AS cluster_id
FROM w LEFT JOIN cs ON cs.doc_id = w.doc_id LEFT JOIN ts ON ts.doc_id = w.doc_id""",
    "t01_stream_upsert": "SELECT conv_id AS session_id, turn AS message_id, role AS sender, text FROM conversations",
    "t02_stream_mirror_turns": "SELECT conv_id AS session_id, turn AS message_id, 'message' AS kind, text FROM conversations UNION ALL SELECT conv_id, turn, 'part', text FROM conversations UNION ALL SELECT conv_id, turn, 'context_item', substr(text, 1, 200) FROM conversations",
    "t04_stream_fresh_tail": "WITH r AS (SELECT conv_id AS session_id, turn AS message_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT session_id, array_to_string(list(CAST(message_id AS VARCHAR) ORDER BY message_id), ',') AS tail FROM r WHERE n <= 3 GROUP BY session_id",
}
