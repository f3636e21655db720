"""Searches over all rows.  The checking SQL is written by hand, pair by pair, or joins words one by one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions.dialect import Duck
from lorewell.operators import bundle, lanes, linear, nearest, packs, rank, vectors
from lorewell.sources.tables import read

from . import context, memory, relational

#: Messages that must be included, and all of a query's episodes: few, as the conversations here are short.
TAIL, EPISODES = 3, 6
#: Lists of the vector index that a query looks into.
PROBES = 16


def l03_episodic_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item is asked in the conversation of its id."""
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("session_id"), F.col("text").alias("query"))
    messages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), "text")
    rounded = [F.round(c, 6).alias(c) for c in ("lexical_score", "semantic_score", "recency_score")]
    return lanes.episodic_lane(queries, messages, TAIL, EPISODES).select("query_id", "session_id", "message_id", "lane", *rounded, "must_include", "place")


def l05_corpus_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lanes.overlap_lane(context.asked(spark, sf_dir), read(spark, sf_dir, "documents").select("doc_id", "text"), "corpus:", context.CORPUS_HITS)
    return rows.select("query_id", "doc_id", F.round("lexical_score", 6).alias("lexical_score"), F.round("semantic_score", 6).alias("semantic_score"))


def l06_large_file_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = context.large_file_texts(read(spark, sf_dir, "documents"))
    return lanes.overlap_lane(context.asked(spark, sf_dir), files, "large_file:", context.LARGE_FILES).select("query_id", "doc_id", F.round("lexical_score", 6).alias("lexical_score"), F.round("semantic_score", 6).alias("semantic_score"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), rank.words(F.col("text")).alias("features"))


def _asked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), rank.words(F.col("text")).alias("features"))


def l01_lexical_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lanes.message_search(_asked_words(spark, sf_dir), _messages(spark, sf_dir), 8, finish=lanes.share)
    return found.select("query_id", "session_id", "message_id", F.col("score").alias("lexical_score"), F.round(F.greatest(F.lit(0.0), F.col("score") - 0.1), 6).alias("semantic_score"), F.lit(0.65).alias("trust_score"))


def l02_semantic_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lanes.message_search(_asked_words(spark, sf_dir), _messages(spark, sf_dir), 8, finish=lanes.jaccard)
    return found.select("query_id", "session_id", "message_id", F.col("score").alias("semantic_score"), F.round(F.greatest(F.lit(0.0), F.col("score") - 0.05), 6).alias("lexical_score"))


def l04_promoted_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of good quality; a row for each label of a document."""
    facts = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id")
    rows = facts.select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("tie"), rank.words(F.col("text")).alias("features"))
    found = linear.linear_top_k(rows, _asked_words(spark, sf_dir), 8)
    return found.select("query_id", F.col("row_id").alias("fact_id"), F.round(0.2 + F.least(F.lit(0.6), 0.08 * F.col("score")), 6).alias("lexical_score"), F.lit(0.85).alias("trust_score"))


def l07_web_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower("html"), "[^a-z0-9]+"), lambda t: F.length(t) >= 3))
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("row_id"), F.col("page_id").alias("tie"), words.alias("features"), F.when(F.startswith("url", F.lit("https://")), 0.7).otherwise(0.6).alias("base"))
    found = linear.linear_top_k(rows, _asked_words(spark, sf_dir), 5, digits=6, finish=lambda s, n, q: np.where(s > 0, 0.1 * s, -np.inf))
    return found.select("query_id", F.col("row_id").alias("page_id"), "score")


def l09_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "").alias("words"))
    return lanes.bm25(_asked_words(spark, sf_dir), docs, 5)


def l11_lexical_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lanes.message_search(_asked_words(spark, sf_dir), _messages(spark, sf_dir), 5)
    return found.withColumn("score", F.col("score").cast("long"))


def j07_token_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lanes.message_search(_asked_words(spark, sf_dir), _messages(spark, sf_dir), 5)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "session_id", "message_id"))
    return found.select(F.col("query_id").alias("item_id"), F.col("session_id").alias("conv_id"), F.col("message_id").alias("turn"), F.col("score").cast("long").alias("shared"), place.cast("long").alias("rn"))


def l10_vector_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.nearest_vectors(rows, queries, 5)


def l10_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in an inverted-file index over all vectors."""
    rows = read(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.ivf_search(vectors.ivf_index(rows), queries, 5, PROBES)


def l02_vector_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French documents asked by a backend that isn't there: the default one answers, and says so."""
    records = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("tie"), "text", F.col("lang").alias("source_type"))
    queries = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return vectors.semantic_search(records, queries, 5, "chroma", "fr").withColumn("score", F.round("score", 6))


def artifacts_and_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as artifacts: the type by the id, the confidence by the label; every twentieth benchmark item asks."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    types = F.array(*map(F.lit, nearest.TYPE_PRIORITY))
    blob = F.lower(F.concat_ws(" ", "text", "source", "lang"))
    artifacts = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("artifact_id"), F.element_at(types, (F.col("doc_id") % 11 + 1).cast("int")).alias("artifact_type"), F.when(F.col("quality") == 1, 0.8).when(F.col("quality") == 0, 0.4).otherwise(0.6).alias("confidence"), blob.alias("blob"))
    says = {"agent_type": F.lit("with_the"), "task_type": F.lit(None).cast("string"), "channel_type": F.lit("and_on"), "language": F.lit("FR"), "style_profile": F.lit("la_le")}
    return artifacts, read(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("request_id"), F.col("text").alias("query"), *(v.alias(k) for k, v in says.items()))


def l16_skill_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.rank_artifacts(*artifacts_and_requests(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


def c13_skill_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events tell how an artifact, the one of their user's id, was used."""
    artifacts, requests = artifacts_and_requests(spark, sf_dir)
    kinds = {"uses": "click", "reinforces": "purchase", "critiques": "error", "supports": "view"}
    signals = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("artifact_id")).agg(*(F.count_if(F.col("event_type") == v).alias(k) for k, v in kinds.items()))
    found = packs.skill_packs(artifacts, requests, signals, 14)
    return found.select("request_id", "place", "artifact_id", "artifact_type", F.round("score", 6).alias("score"), F.round("adjustment", 6).alias("adjustment"))


def l18_similar_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cases; every twentieth asks for the cases of all users that are most like it."""
    e = read(spark, sf_dir, "events")
    about = {"agent_type": F.col("event_type"), "task_type": F.concat(F.lit("t"), (F.floor("value") % 4).cast("string")), "channel_type": F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")), "language": F.when(F.col("user_id") % 2 == 0, "en").otherwise("fr")}
    ids = F.array("event_type", F.concat(F.lit("t"), (F.floor("value") % 4).cast("string")))
    cases = e.select(F.col("event_id").alias("case_id"), F.concat_ws(" ", "event_type", "props").alias("blob"), *(v.alias(k) for k, v in about.items()), ids.alias("artifact_ids"), (F.col("event_type") != "error").alias("success"))
    requests = cases.where("case_id % 20 = 0").select(F.col("case_id").alias("request_id"), F.col("blob").alias("query"), *about, "artifact_ids")
    return nearest.similar_cases(cases, requests, 5).withColumn("score", F.round("score", 6))


def u10_hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a benchmark item in the documents, and the vectors nearest to the item's (that of its id); French documents
    stand for the web."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    web = F.coalesce(F.col("lang") == "fr", F.lit(False)).alias("web")
    rows = docs.select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("tie"), rank.words(F.col("text")).alias("features"))
    lexical = linear.linear_top_k(rows, _asked_words(spark, sf_dir), 20).withColumnRenamed("row_id", "doc_id").join(docs.select("doc_id", web), "doc_id").select("query_id", "doc_id", "web", "score")
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.join(items.select(F.col("item_id").alias("vec_id")).distinct(), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.nearest_vectors(rows, asked, 20).select("query_id", F.col("vec_id").alias("doc_id"), F.lit(False).alias("web"), "score")
    return nearest.hybrid(lexical, found, 20)


def u10_policy_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lanes as stores, each item under a plan and a policy by its number: its list, or one row without a chunk where
    that is empty, and whether the web was used."""
    message = F.concat_ws(":", F.lit("m"), F.col("session_id").cast("string"), F.col("message_id").cast("string"))
    numbered = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    # A computed id: Spark zips the partitions of lists that are all partitioned by one, also where it coalesced them differently.
    of = lambda rows, store, chunk, kind, score: rows.select((F.col("query_id") + F.lit(0)).alias("query_id"), F.lit(store).alias("store"), chunk.alias("chunk_id"), kind.alias("source_type"), F.round(F.col(score).cast("double"), 6).alias("score"))
    hits = of(l05_corpus_lane(spark, sf_dir), "vector", numbered("d:", "doc_id"), F.when(F.col("doc_id") % 3 == 0, "episodic").otherwise("document"), "semantic_score")
    hits = hits.unionByName(of(l11_lexical_store(spark, sf_dir), "lexical", message, F.lit("document"), "score"))
    hits = hits.unionByName(of(l01_lexical_lane(spark, sf_dir), "episodic", message, F.lit("episodic"), "lexical_score"))
    hits = hits.unionByName(of(l07_web_lane(spark, sf_dir), "web", numbered("w:", "page_id"), F.lit("web"), "score"))
    hits = hits.unionByName(of(l04_promoted_lane(spark, sf_dir), "reasoning", numbered("r:", "fact_id"), F.lit("reasoning"), "lexical_score"))
    i = F.col("item_id")
    says = {"use_internal": i % 5 > 0, "use_graph": F.lit(False), "use_episodic": i % 2 == 0, "use_web": i % 3 > 0, "allow_episodic": F.when(i % 4 > 0, i % 8 > 1), "allow_web": F.when(i % 7 > 2, i % 7 > 3), "allow_task": F.lit(None).cast("boolean"), "allow_profile": F.lit(None).cast("boolean"), "allow_reasoning": i % 11 > 0, "mode": F.when(i % 2 == 1, bundle.TASK_MODE)}
    plans = read(spark, sf_dir, "benchmark").select(i.alias("query_id"), *(v.alias(k) for k, v in says.items()))
    chunks = bundle.bundled(bundle.admitted(hits, plans), 10)
    return bundle.augmentation(chunks, plans).join(chunks.drop("ranking_reason").withColumn("rank", F.col("rank").cast("long")), "query_id", "left")


#: The lanes that a plan of relational.py or memory.py checks, with the SQL of that plan, are here as searches.
QUERIES = {f.__name__: f for f in (l01_lexical_lane, l02_semantic_lane, l04_promoted_lane, l07_web_lane, l09_bm25, l11_lexical_store, j07_token_overlap_join, l03_episodic_lane, l05_corpus_lane, l06_large_file_lane, l10_vector_lane, l10_vector_index, l02_vector_backend, l16_skill_ranking, c13_skill_packs, l18_similar_cases, u10_hybrid_retrieval, u10_policy_bundles)}

_WORDS = r"list_distinct(list_filter(string_split_regex(lower({}), '[ \t\n\r\f\x0B]+'), lambda t: t <> ''))"
_TOKENS = r"list_distinct(list_filter(string_split_regex(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda t: t <> ''))"
_COSINES = "SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"

_RANKED = f"""WITH types(n, t, p) AS (VALUES (0, 'principle', 70), (1, 'template', 60), (2, 'execution_lesson', 57), (3, 'evaluation_lesson', 56), (4, 'example', 50),
 (5, 'rubric', 40), (6, 'anti_pattern', 30), (7, 'workflow', 20), (8, 'style_note', 15), (9, 'style_gist', 15), (10, 'raw_chunk', 1)),
l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
a AS (SELECT d.doc_id AS artifact_id, t, p, CASE quality WHEN 1 THEN 0.8 WHEN 0 THEN 0.4 ELSE 0.6 END AS conf, lower(concat_ws(' ', text, source, lang)) AS blob
 FROM documents d JOIN types ON d.doc_id % 11 = n LEFT JOIN l ON l.doc_id = d.doc_id),
w AS (SELECT *, {_TOKENS.format('blob')} AS tok FROM a),
r AS (SELECT item_id AS request_id, {_TOKENS.format('text')} AS q FROM benchmark WHERE item_id % 20 = 0),
s AS (SELECT request_id, artifact_id, t, round(CAST(p + conf * 10 AS DOUBLE) + CASE WHEN len(q) > 0 THEN 16.0 * len(list_intersect(q, tok)) / CAST(len(q) AS DOUBLE) ELSE 0 END
 + CASE WHEN contains(blob, 'with the') THEN 6 ELSE 0 END + CASE WHEN contains(blob, 'and on') THEN 3 ELSE 0 END + CASE WHEN contains(blob, 'fr') THEN 3 ELSE 0 END
 + CASE WHEN contains(blob, 'la le') THEN 4 ELSE 0 END - CASE WHEN t = 'raw_chunk' THEN 8 ELSE 0 END, 6) AS score FROM r, w)"""

ORACLE_SQL = {
    "l03_episodic_lane": f"""
WITH m AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
r AS (SELECT *, back <= 3 AS must, CASE WHEN back <= 3 THEN 1 - (back - 1) / CAST(least(n, 3) AS DOUBLE) ELSE greatest(0.05, 1 - (back - 3) / CAST(n - 2 AS DOUBLE)) END AS rec FROM m WHERE text <> ''),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY must DESC, CASE WHEN must THEN -back END, rec DESC, 'episodic:' || conv_id || ':' || turn) AS place FROM r),
q AS (SELECT item_id, {_WORDS.format('text')} AS qw FROM benchmark),
s AS (SELECT p.*, item_id, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, {_WORDS.format('p.text')})) / CAST(len(qw) AS DOUBLE) ELSE 0 END AS o FROM p JOIN q ON item_id = conv_id WHERE place <= 6)
SELECT item_id AS query_id, conv_id AS session_id, turn AS message_id, CASE WHEN must THEN 'fresh_tail' ELSE 'episodic' END AS lane, round(least(1.0, CASE WHEN must THEN 0.3 ELSE 0.2 END + o), 6) AS lexical_score,
 round(least(1.0, CASE WHEN must THEN 0.4 + 0.8 * o ELSE 0.3 + 0.7 * o END), 6) AS semantic_score, round(rec, 6) AS recency_score, must AS must_include, place FROM s""",
    "l05_corpus_lane": f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text <> ''), q AS (SELECT item_id AS query_id, {_WORDS.format('text')} AS qw FROM benchmark),
s AS (SELECT query_id, doc_id, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, w)) / CAST(len(qw) AS DOUBLE) ELSE 0 END AS o FROM q, d)
SELECT query_id, doc_id, round(o, 6) AS lexical_score, round(greatest(0.2, o), 6) AS semantic_score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o + greatest(0.2, o) DESC, 'corpus:' || doc_id) <= 8""",
    "l06_large_file_lane": f"""
WITH f AS (SELECT doc_id, coalesce(nullif(substr(text, 1, 120), ''), source, 'large file') AS t FROM documents WHERE n_chars > 5000),
q AS (SELECT item_id AS query_id, {_WORDS.format('text')} AS qw FROM benchmark),
s AS (SELECT query_id, doc_id, CASE WHEN len(qw) > 0 THEN len(list_intersect(qw, {_WORDS.format('t')})) / CAST(len(qw) AS DOUBLE) ELSE 0 END AS o FROM q, f)
SELECT query_id, doc_id, round(o, 6) AS lexical_score, round(greatest(0.2, o), 6) AS semantic_score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o + greatest(0.2, o) DESC, 'large_file:' || doc_id) <= 6""",
    "l10_vector_lane": f"{_COSINES} WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) <= 5",
    "l02_vector_backend": f"""
WITH q AS (SELECT item_id AS query_id, {_WORDS.format('text')} AS qw FROM benchmark), d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE lang = 'fr'),
s AS (SELECT query_id, doc_id AS record_id, len(list_intersect(qw, w)) / CAST(greatest(len(list_distinct(list_concat(qw, w))), 1) AS DOUBLE) AS x FROM q, d),
r AS (SELECT query_id, record_id, round(x, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9) DESC, record_id) AS place FROM s WHERE x > 0)
SELECT query_id, record_id, score, 'chroma' AS requested_backend, 'token_jaccard_v1' AS selected_backend, true AS fallback_used, place FROM r WHERE place <= 5""",
    "l16_skill_ranking": f"{_RANKED} SELECT request_id, artifact_id, score FROM s QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, artifact_id) <= 10",
    "c13_skill_packs": f"""{_RANKED}, o(t, rank, quota) AS (VALUES ('principle', 0, 5), ('template', 1, 2), ('rubric', 2, 1), ('workflow', 3, 1), ('anti_pattern', 4, 1), ('style_note', 5, 1), ('execution_lesson', 6, 1), ('evaluation_lesson', 7, 1), ('example', 8, 3), ('raw_chunk', 9, 2)),
n AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS u, count(*) FILTER (event_type = 'purchase') AS r, count(*) FILTER (event_type = 'error') AS c, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY user_id),
g AS (SELECT user_id, CASE WHEN u + r + c < 2 THEN 0 ELSE greatest(-4.5, least(5, least(5, 1.6 * r + 0.4 * u + least(1, 0.2 * v)) - least(4.5, 1.5 * c))) END::DOUBLE AS adj FROM n),
x AS (SELECT request_id, artifact_id, t AS artifact_type, rank, quota, round(score + coalesce(adj, 0), 6) AS score, coalesce(adj, 0) AS adjustment FROM s JOIN o USING (t) LEFT JOIN g ON user_id = artifact_id
 QUALIFY row_number() OVER (PARTITION BY request_id, t ORDER BY round(score + coalesce(adj, 0), 6) DESC, artifact_id) <= quota),
y AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank, score DESC, artifact_id) AS place FROM x QUALIFY place <= 14),
z AS (SELECT *, count(*) FILTER (artifact_type <> 'raw_chunk') OVER (PARTITION BY request_id) AS typed FROM y)
SELECT request_id, place, artifact_id, artifact_type, score, round(adjustment, 6) AS adjustment FROM z WHERE artifact_type <> 'raw_chunk' OR typed < 6""",
    "l18_similar_cases": f"""
WITH c AS (SELECT event_id AS case_id, event_type, 't' || (CAST(floor(value) AS BIGINT) % 4) AS task, user_id % 3 AS channel, user_id % 2 AS lang, {_TOKENS.format("concat_ws(' ', event_type, props)")} AS tok FROM events),
s AS (SELECT a.case_id AS request_id, b.case_id, round(CAST(CASE WHEN a.event_type = b.event_type THEN 6 ELSE 0 END + CASE WHEN a.task = b.task THEN 6 ELSE 0 END + CASE WHEN a.channel = b.channel THEN 4 ELSE 0 END
 + CASE WHEN a.lang = b.lang THEN 3 ELSE 0 END AS DOUBLE) + 12.0 * len(list_intersect(a.tok, b.tok)) / CAST(len(a.tok) AS DOUBLE)
 + 10.0 * (CASE WHEN a.event_type = b.event_type THEN 1 ELSE 0 END + CASE WHEN a.task = b.task THEN 1 ELSE 0 END) / 2.0 + CASE WHEN b.event_type <> 'error' THEN 1.5 ELSE 0 END, 6) AS score
 FROM c a JOIN c b ON a.case_id <> b.case_id WHERE a.case_id % 20 = 0)
SELECT request_id, case_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, case_id) <= 5""",
    "u10_hybrid_retrieval": f"""
WITH q AS (SELECT item_id AS query_id, unnest({_WORDS.format('text')}) AS word FROM benchmark),
w AS (SELECT doc_id, coalesce(lang = 'fr', false) AS web, unnest({_WORDS.format('text')}) AS word FROM documents),
x AS (SELECT query_id, doc_id, bool_or(web) AS web, CAST(count(*) AS DOUBLE) AS score FROM q JOIN w USING (word) GROUP BY query_id, doc_id
 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20),
v AS ({_COSINES} WHERE a.vec_id IN (SELECT item_id FROM benchmark) QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) <= 20),
u AS (SELECT query_id, doc_id, max(score) AS score, bool_or(web) AS web FROM (SELECT query_id, doc_id, web, score FROM x UNION ALL SELECT query_id, vec_id, false, score FROM v) z GROUP BY query_id, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM u),
n AS (SELECT *, sum(CAST(web AS BIGINT)) OVER (PARTITION BY query_id ORDER BY place) AS nth_web, max(score) OVER (PARTITION BY query_id) < 3 AS augment FROM o WHERE place <= 20)
SELECT query_id, doc_id, score, place, augment FROM n WHERE NOT web OR nth_web <= 2""",
}

def _lane(name: str) -> str:
    """A lane's checking SQL, wherever it is kept."""
    return ORACLE_SQL[name] if name in ORACLE_SQL else (relational.PLANS | memory.PLANS)[name](Duck())


ORACLE_SQL["u10_policy_bundles"] = f"""WITH h AS (SELECT query_id, 0 AS store, 'd:' || doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'episodic' ELSE 'document' END AS source_type, semantic_score AS s FROM ({_lane("l05_corpus_lane")}) a
 UNION ALL SELECT query_id, 1, 'm:' || session_id || ':' || message_id, 'document', score FROM ({_lane("l11_lexical_store")}) b UNION ALL SELECT query_id, 3, 'm:' || session_id || ':' || message_id, 'episodic', lexical_score FROM ({_lane("l01_lexical_lane")}) c
 UNION ALL SELECT query_id, 4, 'w:' || page_id, 'web', score FROM ({_lane("l07_web_lane")}) d UNION ALL SELECT query_id, 7, 'r:' || fact_id, 'reasoning', lexical_score FROM ({_lane("l04_promoted_lane")}) e),
p AS (SELECT item_id AS query_id, item_id % 5 > 0 AS internal, item_id % 2 = 0 AS episodic, item_id % 3 > 0 AS web, item_id % 4 = 0 OR item_id % 8 > 1 AS may_recall, CASE WHEN item_id % 7 > 2 THEN item_id % 7 > 3 ELSE item_id % 3 > 0 END AS may_web, item_id % 2 = 1 AND item_id % 11 > 0 AS reasons FROM benchmark),
g AS (SELECT h.query_id, store, chunk_id, source_type, round(CAST(s AS DOUBLE), 6) AS s FROM h JOIN p ON p.query_id = h.query_id WHERE CASE store WHEN 0 THEN internal AND (may_recall OR source_type = 'document') WHEN 1 THEN internal WHEN 3 THEN episodic AND may_recall WHEN 4 THEN web AND may_web ELSE reasons END),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY s DESC, store) AS best, row_number() OVER (PARTITION BY query_id ORDER BY store, s DESC, chunk_id) AS arrival FROM g),
o AS (SELECT query_id, chunk_id, min(arrival) AS arrival, max(s) AS s, min(CASE WHEN best = 1 THEN source_type END) AS source_type FROM f GROUP BY query_id, chunk_id),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, arrival) AS n FROM o QUALIFY n <= 10),
w AS (SELECT *, sum(CASE WHEN source_type = 'web' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY n) AS webs FROM n),
k AS (SELECT query_id, chunk_id, source_type, s, row_number() OVER (PARTITION BY query_id ORDER BY n) AS rank FROM w WHERE source_type <> 'web' OR webs <= 2),
u AS (SELECT query_id, bool_or(source_type = 'web') AS used FROM k GROUP BY query_id)
SELECT p.query_id, web AS considered, may_web AS allowed, coalesce(used, false) AS used, CASE WHEN NOT web THEN 'web not requested by plan' WHEN NOT may_web THEN 'web requested by plan but blocked by policy' WHEN used THEN 'web used because plan requested it and policy allowed it' ELSE 'web allowed but search returned no usable results' END AS reason,
 rank, chunk_id, source_type, s AS final_score FROM p LEFT JOIN u ON u.query_id = p.query_id LEFT JOIN k ON k.query_id = p.query_id"""
