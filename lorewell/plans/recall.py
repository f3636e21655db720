"""A session's items (K04, C08): search, descriptions, expansion and walks; the checking SQL is written by hand.

Conversations are sessions.  Each message has two parts, every fourth a third; three messages are a segment, whose
summary is a node below its session's, which is below the node of ten sessions.  Every seventh message is gone from the
log and only in its segment's snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators import recall
from lorewell.sources.tables import read


def node_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of summary nodes: each chunk's and session's twice, the second time from another session."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    chunks = c.groupBy("conv_id", F.expr("turn div 3").alias("chunk")).agg(F.min_by("text", "turn").alias("text"))
    chunks = chunks.select(F.concat_ws("-", F.lit("n"), "conv_id", "chunk").alias("node_id"), F.col("conv_id").cast("string").alias("session_id"), F.substring("text", 1, 60).alias("text"))
    sessions = c.groupBy("conv_id").agg(F.count("*").alias("n")).select(F.concat_ws("-", F.lit("s"), "conv_id").alias("node_id"), F.col("conv_id").cast("string").alias("session_id"), F.concat(F.col("n").cast("string"), F.lit(" turns")).alias("text"))
    tens = c.select(F.expr("conv_id div 10").alias("ten")).distinct().select(F.concat_ws("-", F.lit("t"), "ten").alias("node_id"), F.lit("all").alias("session_id"), F.lit("ten sessions").alias("text"))
    first = chunks.unionByName(sessions).unionByName(tens).withColumn("at", F.lit(1))
    again = first.where("node_id not like 't-%'").select("node_id", F.lit("other").alias("session_id"), F.concat("text", F.lit(" (again)")).alias("text"), F.lit(2).alias("at"))
    return first.unionByName(again)


def edge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts lead to wholes and back; a chunk to the next one, and the last to the first."""
    c = read(spark, sf_dir, "conversations").select("conv_id", F.expr("turn div 3").alias("chunk")).distinct()
    most = c.groupBy("conv_id").agg(F.max("chunk").alias("most"))
    chunk, session, ten = F.concat_ws("-", F.lit("n"), "conv_id", "chunk"), F.concat_ws("-", F.lit("s"), "conv_id"), F.concat_ws("-", F.lit("t"), F.expr("conv_id div 10"))
    after = F.concat_ws("-", F.lit("n"), "conv_id", F.when(F.col("chunk") == F.col("most"), 0).otherwise(F.col("chunk") + 1))

    def edges(rows: DataFrame, a, b, name: str, weight: float) -> DataFrame:
        return rows.select(a.alias("from_id"), b.alias("to_id"), F.lit(name).alias("relation"), F.lit(weight).alias("weight"), F.lit(1).alias("at"))

    ids = c.select("conv_id").distinct()
    up = edges(c, chunk, session, "part_of", 1.0).unionByName(edges(ids, session, ten, "part_of", 0.5))
    out = up.unionByName(edges(c, session, chunk, "covers", 1.0)).unionByName(edges(c.join(most, "conv_id"), chunk, after, "next", 0.25))
    return out.unionByName(up.withColumns({"weight": F.col("weight") + 1.0, "at": F.lit(2)}))


def stores(spark: SparkSession, sf_dir: str) -> recall.SessionStores:
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("idx"), F.col("role").alias("sender"), "text")
    parts = c.withColumn("part_index", F.explode(F.when(F.col("idx") % 4 == 0, F.array(*map(F.lit, range(3)))).otherwise(F.array(F.lit(0), F.lit(1)))))
    first, second = F.col("part_index") == 0, F.col("part_index") == 1
    call = F.when(first, F.concat(F.lit("call"), (F.col("idx") % 2).cast("string"))).when(second & (F.col("idx") % 2 == 0), "call0")
    retry = F.when(second & (F.col("idx") % 3 == 0), 0).when(F.col("part_index") == 2, 1)
    parts = parts.select("session_id", F.col("idx").cast("string").alias("message_id"), "part_index", F.substring("text", F.col("part_index") * 10 + 1, F.lit(10)).alias("text"), F.when(first, "tool_call").otherwise("text").alias("part_type"), F.when(first, "failed").otherwise("done").alias("status"), retry.alias("retry_of_part_index"), F.when(first, "grep").alias("tool_name"), call.alias("tool_call_id"), F.when(second, F.array(F.lit("notes.txt"))).alias("file_refs"))
    whole = c.select("session_id", F.col("idx").cast("string").alias("message_id"), "idx", "sender", "text")
    held = whole.groupBy("session_id", F.expr("idx div 3").alias("chunk_index")).agg(F.array_sort(F.collect_list(F.struct("idx", "message_id", "text"))).alias("snapshot"))
    segments = held.select("session_id", F.concat_ws(":", F.lit("seg"), "session_id", "chunk_index").alias("segment_id"), "chunk_index", F.substring(F.element_at("snapshot", 1)["text"], 1, 80).alias("summary"), F.lit("active").alias("status"), F.lit("older_than_tail").alias("policy_reason"), F.element_at("snapshot", 1)["idx"].alias("start_index"), F.element_at("snapshot", -1)["idx"].alias("end_index"), "snapshot")
    nodes = recall.upserted(node_log(spark, sf_dir), ["node_id"], ["at"], ["session_id"])
    edges = recall.upserted(edge_log(spark, sf_dir), ["from_id", "to_id", "relation"], ["at"])
    files = read(spark, sf_dir, "documents").where("n_chars > 5000").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("record_id"), F.concat_ws("/", "source", "lang").alias("file_path"), F.to_json(F.struct("n_chars")).alias("metadata"))
    return recall.SessionStores(whole.where("idx % 7 <> 6"), parts, nodes, edges, segments, files)


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message, its first two parts, every chunk's segment and node, every large file, and what doesn't exist."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "turn")
    none = F.lit(None).cast("string").alias("secondary_id")
    turn, chunk = F.col("turn").cast("string").alias("primary_id"), F.expr("turn div 3")
    out = c.select(F.lit("message").alias("item_type"), "session_id", turn, none)
    out = out.unionByName(c.select(F.lit("message_part").alias("item_type"), "session_id", turn, F.explode(F.array(F.lit(None), F.lit("1"))).alias("secondary_id")))
    out = out.unionByName(c.select(F.lit("compacted_summary").alias("item_type"), "session_id", F.concat_ws(":", F.lit("seg"), "session_id", chunk).alias("primary_id"), none).distinct())
    out = out.unionByName(c.select(F.lit("summary_node").alias("item_type"), "session_id", F.concat_ws("-", F.lit("n"), "session_id", chunk).alias("primary_id"), none).distinct())
    files = read(spark, sf_dir, "documents").where("n_chars > 4900").select(F.lit("large_file").alias("item_type"), F.lit(None).cast("string").alias("session_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("primary_id"), none)
    return out.unionByName(files).unionByName(c.select(F.lit("odd").alias("item_type"), "session_id", F.lit("x").alias("primary_id"), none).distinct())


def k04_summary_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.upserted(node_log(spark, sf_dir), ["node_id"], ["at"], ["session_id"]).select("node_id", "session_id", "text")


def c08_walk_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a chunk's node leads to, in three steps along any edge."""
    edges = recall.upserted(edge_log(spark, sf_dir), ["from_id", "to_id", "relation"], ["at"])
    starts = edges.where("relation = 'next'").select(F.col("from_id").alias("start_id"))
    return recall.walk(edges, starts, most_depth=3)


def c08_walk_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = recall.upserted(edge_log(spark, sf_dir), ["from_id", "to_id", "relation"], ["at"])
    return recall.walk(edges, edges.select(F.col("from_id").alias("start_id")), ("part_of",))



def c08_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recall.describe(stores(spark, sf_dir), refs(spark, sf_dir))
    return found.select(*recall.REF, "known", F.sha1("preview").alias("preview"), F.col("metadata")["status"].alias("status"), F.col("metadata")["source_count"].alias("source_count"))


def c08_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recall.expand(stores(spark, sf_dir), refs(spark, sf_dir))
    keep = [F.col(f"ref_{c}") for c in recall.REF]
    return found.select(*keep, "item_type", "primary_id", "secondary_id", F.sha1("preview").alias("preview"), F.col("metadata")["recovered_from"].alias("recovered_from"))


def p08_session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session is asked for a word over all that it holds."""
    queries = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("session_id")).distinct().withColumn("query", F.lit("With"))
    return recall.search(stores(spark, sf_dir), queries, 6).select("query_id", "item_type", "primary_id", "secondary_id", "place")


QUERIES = {f.__name__: f for f in (k04_summary_nodes, c08_walk_sources, c08_walk_ancestors, c08_describe, c08_expand)} | {"p08_session_memory_search": p08_session_search}

_NODES = """c AS (SELECT conv_id, turn, text FROM conversations),
nodes AS (SELECT 'n-' || conv_id || '-' || turn // 3 AS node_id, conv_id::VARCHAR AS session_id, substr(arg_min(text, turn), 1, 60) || ' (again)' AS text FROM c GROUP BY conv_id, turn // 3
 UNION ALL SELECT 's-' || conv_id, conv_id::VARCHAR, count(*) || ' turns (again)' FROM c GROUP BY conv_id UNION ALL SELECT DISTINCT 't-' || conv_id // 10, 'all', 'ten sessions' FROM c)"""
_EDGES = """k AS (SELECT DISTINCT conv_id, turn // 3 AS chunk FROM conversations), m AS (SELECT conv_id, max(chunk) AS most FROM k GROUP BY conv_id),
edges AS (SELECT 'n-' || conv_id || '-' || chunk AS a, 's-' || conv_id AS b, 'part_of' AS relation FROM k UNION ALL SELECT 's-' || conv_id, 't-' || conv_id // 10, 'part_of' FROM m
 UNION ALL SELECT 's-' || conv_id, 'n-' || conv_id || '-' || chunk, 'covers' FROM k
 UNION ALL SELECT 'n-' || conv_id || '-' || chunk, 'n-' || conv_id || '-' || CASE WHEN chunk = most THEN 0 ELSE chunk + 1 END, 'next' FROM k JOIN m USING (conv_id))"""
_STORES = f"""{_NODES}, {_EDGES}, msg AS (SELECT conv_id::VARCHAR AS s, turn, turn::VARCHAR AS id, text FROM conversations), kept AS (SELECT * FROM msg WHERE turn % 7 <> 6),
parts AS (SELECT s, id, p, substr(text, p * 10 + 1, 10) AS text, CASE WHEN p = 0 THEN 'call' || turn % 2 WHEN p = 1 AND turn % 2 = 0 THEN 'call0' END AS call, CASE WHEN p = 1 AND turn % 3 = 0 THEN 0 WHEN p = 2 THEN 1 END AS retry,
 CASE WHEN p = 0 THEN 'failed' ELSE 'done' END AS status, turn FROM (SELECT *, unnest(CASE WHEN turn % 4 = 0 THEN [0, 1, 2] ELSE [0, 1] END) AS p FROM msg) x),
seg AS (SELECT s, 'seg:' || s || ':' || turn // 3 AS id, turn // 3 AS chunk, substr(arg_min(text, turn), 1, 80) AS summary, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS texts FROM msg GROUP BY s, turn // 3),
files AS (SELECT 'f' || doc_id AS id, concat_ws('/', source, lang) AS path, '{{"n_chars":' || n_chars || '}}' AS meta, n_chars FROM documents WHERE n_chars > 4900)"""

ORACLE_SQL = {
    "k04_summary_nodes": f"WITH {_NODES} SELECT * FROM nodes",
    "c08_walk_sources": f"""WITH RECURSIVE {_EDGES}, w(start_id, node_id, depth) AS (SELECT DISTINCT a, a, 0::BIGINT FROM edges WHERE relation = 'next' UNION SELECT start_id, b, depth + 1 FROM w JOIN edges ON a = node_id WHERE depth < 3)
SELECT start_id, node_id, min(depth) AS depth FROM w GROUP BY start_id, node_id""",
    "c08_walk_ancestors": f"""WITH RECURSIVE {_EDGES}, w(start_id, node_id, depth) AS (SELECT DISTINCT a, a, 0::BIGINT FROM edges UNION SELECT start_id, b, depth + 1 FROM w JOIN edges ON a = node_id AND relation = 'part_of')
SELECT start_id, node_id, min(depth) AS depth FROM w GROUP BY start_id, node_id""",
    "c08_describe": f"""WITH {_STORES}
SELECT 'message' AS item_type, m.s AS session_id, m.id AS primary_id, NULL AS secondary_id, k.id IS NOT NULL AS known, sha1(substr(k.text, 1, 512)) AS preview, NULL AS status, NULL AS source_count FROM msg m LEFT JOIN kept k ON k.s = m.s AND k.id = m.id
UNION ALL SELECT 'message_part', s, id, CASE WHEN p = 1 THEN '1' END, true, sha1(text), status, NULL FROM parts WHERE p < 2
UNION ALL SELECT 'compacted_summary', s, id, NULL, true, sha1(summary), 'active', n::VARCHAR FROM seg
UNION ALL SELECT 'summary_node', session_id, node_id, NULL, true, sha1(text), NULL, NULL FROM nodes WHERE node_id LIKE 'n-%'
UNION ALL SELECT 'large_file', NULL, id, NULL, n_chars > 5000, CASE WHEN n_chars > 5000 THEN sha1(meta) END, NULL, NULL FROM files
UNION ALL SELECT DISTINCT 'odd', s, 'x', NULL, false, NULL, NULL, NULL FROM msg""",
    "c08_expand": f"""WITH {_STORES}
SELECT 'message' AS ref_item_type, m.s AS ref_session_id, m.id AS ref_primary_id, NULL AS ref_secondary_id, 'message_part' AS item_type, p.id AS primary_id, p.p::VARCHAR AS secondary_id, sha1(p.text) AS preview, NULL AS recovered_from FROM msg m JOIN parts p ON p.s = m.s AND p.id = m.id
UNION ALL SELECT 'message_part', a.s, a.id, CASE WHEN a.p = 1 THEN '1' END, 'message_part', b.id, b.p::VARCHAR, sha1(b.text), NULL FROM parts a JOIN parts b ON a.s = b.s AND a.id = b.id AND a.p <> b.p AND a.p < 2 AND (a.call = b.call OR b.retry = a.p OR a.retry = b.p)
UNION ALL SELECT 'compacted_summary', g.s, g.id, NULL, 'message', m.id, NULL, sha1(substr(m.text, 1, 256)), CASE WHEN m.turn % 7 <> 6 THEN 'raw' ELSE 'snapshot' END FROM seg g JOIN msg m ON m.s = g.s AND m.turn // 3 = g.chunk
UNION ALL SELECT 'summary_node', n.session_id, a, NULL, 'summary_edge', a, b, sha1(relation || '->' || b), NULL FROM edges JOIN nodes n ON n.node_id = a WHERE a LIKE 'n-%'
UNION ALL SELECT 'large_file', NULL, id, NULL, 'large_file_meta', id, NULL, sha1(path), NULL FROM files WHERE n_chars > 5000""",
    "p08_session_memory_search": f"""WITH {_STORES}, hits AS (
 SELECT s, 0 AS kind, 'message' AS item_type, id AS primary_id, NULL AS secondary_id, turn AS o, '' AS i, 0 AS j FROM kept WHERE contains(lower(text), 'with')
 UNION ALL SELECT s, 1, 'message_part', id, p::VARCHAR, 0, id, p FROM parts WHERE contains(lower(text), 'with')
 UNION ALL SELECT s, 2, 'compacted_summary', id, NULL, chunk, id, 0 FROM seg WHERE contains(lower(texts), 'with')
 UNION ALL SELECT session_id, 3, 'summary_node', node_id, NULL, 0, node_id, 0 FROM nodes WHERE contains(lower(text), 'with'))
SELECT s::BIGINT AS query_id, item_type, primary_id, secondary_id, row_number() OVER (PARTITION BY s ORDER BY kind, o, i, j) AS place FROM hits WHERE s <> 'all' QUALIFY place <= 6""",
}
