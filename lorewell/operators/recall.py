"""A session's items by reference: searched, described, expanded to what hangs on them, and walked along summary edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a preview in a reference and in a description.
REF_PREVIEW, TOLD_PREVIEW = 256, 512
REF = ("item_type", "session_id", "primary_id", "secondary_id")
FOUND = "item_type", "session_id", "primary_id", "secondary_id", "preview", "metadata"


@dataclass(frozen=True)
class SessionStores:
    """messages: session_id, message_id, idx, sender, text; parts: session_id, message_id, part_index, text, part_type,
    status, retry_of_part_index, tool_name, tool_call_id, file_refs (array); nodes: node_id, session_id, text; edges:
    from_id, to_id, relation, weight; segments: session_id, segment_id, chunk_index, summary, status, policy_reason,
    start_index, end_index, snapshot (array of message_id, idx, text); files: record_id, file_path, metadata."""

    messages: DataFrame
    parts: DataFrame
    nodes: DataFrame
    edges: DataFrame
    segments: DataFrame
    files: DataFrame


def upserted(log: DataFrame, keys: list[str], order: list[str], first: list[str] = ()) -> DataFrame:
    """A store after a log of writes: of each key the last write's columns, but those in `first` as the first write had
    them.  Ties of `order` go by the other columns.  Partial sums go before the one shuffle."""
    rest = [c for c in log.columns if c not in keys]
    place = F.struct(*order, *(c for c in rest if c not in order))
    return log.groupBy(*keys).agg(*((F.min_by if c in first else F.max_by)(c, place).alias(c) for c in rest))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _details(**values: Column) -> Column:
    """A map of strings; what is null isn't in it."""
    if not values:
        return F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
    pairs = F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(k), v.cast("string"))) for k, v in values.items())))
    return F.map_from_entries(pairs)


def _part_details() -> Column:
    return _details(part_type=F.col("part_type"), status=F.col("status"), retry_of_part_index=F.col("retry_of_part_index"), tool_name=F.col("tool_name"), tool_call_id=F.col("tool_call_id"), file_refs=F.array_join("file_refs", ","))


def _segment_details() -> Column:
    return _details(status=F.col("status"), policy_reason=F.col("policy_reason"), source_count=F.size("snapshot"), source_index_start=F.col("start_index"), source_index_end=F.col("end_index"), recoverability=F.lit("raw_or_snapshot"))


def _items(s: SessionStores, preview: int) -> dict[str, DataFrame]:
    """Everything that a reference can name: item_type, session_id, primary_id, secondary_id, hay, preview, metadata, place."""

    def shaped(rows: DataFrame, kind: str, primary: str, secondary: Column, shown: str, hay: Column, metadata: Column, *place: Column) -> DataFrame:
        session = F.col("session_id").cast("string") if "session_id" in rows.columns else F.lit(None).cast("string")
        order = F.struct(*(p.alias(f"p{i}") for i, p in enumerate(place)))
        return rows.select(F.lit(kind).alias("item_type"), session.alias("session_id"), F.col(primary).cast("string").alias("primary_id"), secondary.cast("string").alias("secondary_id"), F.lower(hay).alias("hay"), F.substring(_text(shown), 1, preview).alias("preview"), metadata.alias("metadata"), order.alias("place"))

    none, number = F.lit(None), lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    in_part = F.concat_ws(" ", *(_text(c) for c in ("text", "tool_name", "tool_call_id", "part_type", "status")), F.array_join("file_refs", " "))
    in_segment = F.concat_ws(" ", _text("summary"), F.array_join(F.transform("snapshot", lambda m: F.coalesce(m["text"], F.lit(""))), " "), _text("policy_reason"), _text("status"))
    return {
        "message": shaped(s.messages, "message", "message_id", none, "text", _text("text"), _details(sender=F.col("sender")), number("idx"), _text("message_id")),
        "message_part": shaped(s.parts, "message_part", "message_id", F.col("part_index"), "text", in_part, _part_details(), F.lit(0), _text("message_id"), number("part_index")),
        "compacted_summary": shaped(s.segments, "compacted_summary", "segment_id", none, "summary", in_segment, _segment_details(), number("chunk_index"), _text("segment_id")),
        "summary_node": shaped(s.nodes, "summary_node", "node_id", none, "text", _text("text"), _details(), F.lit(0), _text("node_id")),
        "large_file": shaped(s.files, "large_file", "record_id", none, "metadata", _text("file_path"), _details(file_path=F.col("file_path"), raw=F.col("metadata")), F.lit(0), _text("record_id")),
    }


def search(s: SessionStores, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, FOUND, place): of each query (query_id, session_id, query) the first k items of its session that hold it.

    Messages come first, then parts, compacted summaries and summary nodes, each in their own order; letters of either
    case are equal, and an empty query is held by everything."""
    asked = queries.select("query_id", F.col("session_id").cast("string").alias("session_id"), F.lower(F.coalesce("query", F.lit(""))).alias("query"))
    out = None
    for rank, kind in enumerate(("message", "message_part", "compacted_summary", "summary_node")):
        rows = _items(s, REF_PREVIEW)[kind].join(asked, "session_id").where(F.contains("hay", F.col("query")))
        order = Window.partitionBy("query_id").orderBy("place")
        rows = rows.withColumn("own", F.row_number().over(order)).where(F.col("own") <= k).select("query_id", *FOUND, F.lit(rank).alias("rank"), "own")
        out = rows if out is None else out.unionByName(rows)
    order = Window.partitionBy("query_id").orderBy("rank", "own")
    return out.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k).select("query_id", *FOUND, "place")


def describe(s: SessionStores, refs: DataFrame) -> DataFrame:
    """Each reference (REF) with known, preview and metadata; an unknown one has known = false and nothing else.

    A summary node and a large file are found in any session; a part without a secondary_id is the first."""
    out = None
    for kind, items in _items(s, TOLD_PREVIEW).items():
        some = refs.where(F.col("item_type") == kind)
        on = [some["primary_id"] == items["primary_id"]]
        if kind in ("message", "message_part", "compacted_summary"):
            on.append(some["session_id"] == items["session_id"])
        if kind == "message_part":
            on.append(F.coalesce(some["secondary_id"], F.lit("0")) == items["secondary_id"])
        rows = some.join(items, on, "left").select(*(some[c] for c in REF), items["item_type"].isNotNull().alias("known"), "preview", "metadata")
        out = rows if out is None else out.unionByName(rows)
    other = refs.where(~F.coalesce(F.col("item_type").isin(*_items(s, 1)), F.lit(False)))
    return out.unionByName(other.select(*REF, F.lit(False).alias("known"), F.lit(None).cast("string").alias("preview"), F.lit(None).cast("map<string,string>").alias("metadata")))


def expand(s: SessionStores, refs: DataFrame) -> DataFrame:
    """(REF of each reference as ref_..., FOUND): what hangs directly on it.

    A summary node leads along its edges, a message to its parts, a part to those of the same tool call and to its retries
    and what it retries, a large file to its metadata, a compacted summary to its messages: as they are, or as the
    snapshot has them where they are gone.  Other references, and unknown ones, lead nowhere."""
    asked = refs.select(*(F.col(c).alias(f"ref_{c}") for c in REF)).distinct()
    kind = lambda name: asked.where(F.col("ref_item_type") == name)
    keep = [f"ref_{c}" for c in REF]
    items = _items(s, REF_PREVIEW)
    parts = items["message_part"].join(s.parts.select(F.col("session_id").cast("string").alias("session_id"), F.col("message_id").cast("string").alias("primary_id"), F.col("part_index").cast("string").alias("secondary_id"), F.col("tool_call_id").alias("call"), F.col("retry_of_part_index").cast("string").alias("retry")), ["session_id", "primary_id", "secondary_id"])

    edges = s.edges.select(F.col("from_id").alias("ref_primary_id"), "to_id", "relation", "weight")
    by_edge = kind("summary_node").join(edges, "ref_primary_id").select(*keep, F.lit("summary_edge").alias("item_type"), F.col("ref_session_id").alias("session_id"), F.col("ref_primary_id").alias("primary_id"), F.col("to_id").alias("secondary_id"), F.concat_ws("->", "relation", "to_id").alias("preview"), _details(weight=F.col("weight")).alias("metadata"))
    of_message = kind("message").join(parts, (F.col("ref_session_id") == F.col("session_id")) & (F.col("ref_primary_id") == F.col("primary_id"))).select(*keep, *FOUND)

    own = parts.select(F.col("session_id").alias("ref_session_id"), F.col("primary_id").alias("ref_primary_id"), F.col("secondary_id").alias("own_part"), F.col("call").alias("own_call"), F.col("retry").alias("own_retry"))
    chosen = kind("message_part").withColumn("own_part", F.coalesce("ref_secondary_id", F.lit("0"))).join(own, ["ref_session_id", "ref_primary_id", "own_part"])
    related = ((F.col("own_call") != "") & (F.col("call") == F.col("own_call"))) | (F.col("retry") == F.col("own_part")) | (F.col("own_retry") == F.col("secondary_id"))
    of_part = chosen.join(parts, (F.col("ref_session_id") == F.col("session_id")) & (F.col("ref_primary_id") == F.col("primary_id"))).where((F.col("secondary_id") != F.col("own_part")) & related).select(*keep, *FOUND)

    files = s.files.select(F.col("record_id").cast("string").alias("ref_primary_id"), "file_path", F.col("metadata").alias("raw"))
    of_file = kind("large_file").join(files, "ref_primary_id").select(*keep, F.lit("large_file_meta").alias("item_type"), F.col("ref_session_id").alias("session_id"), F.col("ref_primary_id").alias("primary_id"), F.lit(None).cast("string").alias("secondary_id"), F.coalesce("file_path", F.lit("")).alias("preview"), _details(raw=F.col("raw")).alias("metadata"))

    held = s.segments.select(F.col("session_id").cast("string").alias("ref_session_id"), F.col("segment_id").cast("string").alias("ref_primary_id"), F.explode("snapshot").alias("m"))
    held = kind("compacted_summary").join(held, ["ref_session_id", "ref_primary_id"]).withColumn("message", F.col("m.message_id").cast("string"))
    now = s.messages.select(F.col("session_id").cast("string").alias("now_session"), F.col("message_id").cast("string").alias("now_message"), F.col("text").alias("now_text"))
    back = held.join(now, (F.col("ref_session_id") == F.col("now_session")) & (F.col("message") == F.col("now_message")), "left")
    there = F.col("now_message").isNotNull()
    told = _details(from_compaction_segment=F.col("ref_primary_id"), recovered_from=F.when(there, "raw").otherwise("snapshot"), source_index=F.col("m.idx"))
    of_segment = back.select(*keep, F.lit("message").alias("item_type"), F.col("ref_session_id").alias("session_id"), F.coalesce("message", F.concat(F.lit("index-"), F.col("m.idx").cast("string"))).alias("primary_id"), F.lit(None).cast("string").alias("secondary_id"), F.substring(F.coalesce(F.when(there, F.col("now_text")).otherwise(F.col("m.text")), F.lit("")), 1, REF_PREVIEW).alias("preview"), told.alias("metadata"))
    return by_edge.unionByName(of_message).unionByName(of_part).unionByName(of_file).unionByName(of_segment)


def walk(edges: DataFrame, starts: DataFrame, relations: tuple[str, ...] = (), most_depth: int = 16) -> DataFrame:
    """(start_id, node_id, depth): every node that can be reached from a start, by the fewest edges; the start has 0.

    edges: from_id, to_id, relation; starts: start_id.  `relations` keeps only those edges.  Each round joins the nodes
    that the last one found with the edges and drops what is known, so cycles end; it ends when nothing new is found, or
    after most_depth rounds.  Rounds are written, so none is computed twice."""
    from lorewell.streaming.ingest import shared_path

    spark = edges.sparkSession
    ways = edges.where(F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    if relations:
        ways = ways.where(F.col("relation").isin(*relations))
    ways = ways.select(F.col("from_id").alias("node_id"), "to_id").distinct()
    path = shared_path(spark, "walk")
    starts.where("start_id is not null").select("start_id", F.col("start_id").alias("node_id")).distinct().write.parquet(f"{path}/depth=0")
    for depth in range(1, most_depth + 1):
        known, last = spark.read.parquet(path).drop("depth"), spark.read.parquet(f"{path}/depth={depth - 1}")
        found = last.join(ways, "node_id").select("start_id", F.col("to_id").alias("node_id")).distinct().join(known, ["start_id", "node_id"], "left_anti")
        found.write.parquet(f"{path}/depth={depth}")
        if spark.read.parquet(f"{path}/depth={depth}").isEmpty():
            break
    return spark.read.parquet(path).select("start_id", "node_id", F.col("depth").cast("long").alias("depth"))
