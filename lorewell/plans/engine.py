"""The service surface as functions over versioned tables in a folder: ingest, sessions, compaction, promotion, queries.

A table is a folder of Parquet versions; a write merges into the latest one and leaves a new version, so readers never
see half a write and a failed one leaves none.  Every read is a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions import lexicons as lx
from lorewell.operators import chunk, merge, rank, select
from lorewell.sources.tables import load_files

#: Schema, key and columns that the first writer fixes.
TABLES = {
    "messages": ("session_id string, message_id string, seq long, sender string, text string", ["session_id", "message_id"], []),
    "parts": ("session_id string, message_id string, part_index int, seq long, part_type string, text string, status string", ["session_id", "message_id", "part_index"], []),
    "items": ("item_id string, session_id string, seq long, kind string, text string", ["item_id"], ["session_id"]),
    "segments": ("segment_id string, session_id string, chunk long, seq long, summary string, lineage array<string>, quarantined boolean", ["segment_id"], []),
    "patterns": ("pattern_id string, seq long, text string, confidence double, reuse_count long, provenance array<string>", ["pattern_id"], []),
    "documents": ("document_id string, source_path string, kind string, seq long, text string", ["document_id"], []),
    "chunks": ("document_id string, chunk_index int, kind string, title string, char_start int, char_end int, text string", ["document_id", "chunk_index"], []),
}
#: Messages shorter than this are of low value: they are put aside and not summed up.
LOW_VALUE = 30


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


class MemoryEngine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- tables ----

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path)]
        return sorted(int(p.getName()[1:]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def table(self, name: str) -> DataFrame:
        """The latest version; empty before the first write."""
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], TABLES[name][0])
        return self.spark.read.schema(self.spark.createDataFrame([], TABLES[name][0]).schema).parquet(f"{self.root}/{name}/v{versions[-1]}")

    def _write(self, name: str, rows: DataFrame) -> None:
        version = (self._versions(name) or [0])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{version}")

    def upsert(self, name: str, rows: DataFrame) -> dict[str, int]:
        """Merge rows by the table's key, the greatest seq wins; how many were new and how many replaced others."""
        schema, key, fixed = TABLES[name]
        types = dict(c.split(" ") for c in schema.split(", "))
        rows = rows.select(*(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()))
        old = self.table(name)
        keys = rows.select(*key).distinct()
        replaced = keys.join(old.select(*key), key, "left_semi").count()
        inserted = keys.count() - replaced
        order = [F.col("seq")] if "seq" in types else []
        both = old.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
        merged = merge.upsert(both.limit(0), both, key, (["seq"] if order else []) + ["_new"], fixed)
        self._write(name, merged.drop("_new"))
        return {"inserted": inserted, "replaced": replaced}

    # ---- ingest and corpus ----

    def ingest(self, path: str, size: int = 1024, overlap: int = 100) -> int:
        """Read text files, upsert documents and replace their chunks; the number of documents read."""
        docs = load_files(self.spark, path).withColumn("seq", F.lit(0).cast("long")).dropDuplicates(["document_id"])
        self.upsert("documents", docs)
        fresh = chunk.chunk(docs, size, overlap).select(*(c.split()[0] for c in TABLES["chunks"][0].split(", ")))
        self._write("chunks", merge.replace_children(self.table("chunks"), fresh, "document_id"))
        return docs.count()

    def query(self, text: str, k: int = 8) -> DataFrame:
        """The chunks with most of a query's words: document_id, chunk_index, text, score."""
        score = rank.overlap_ratio(F.lit(text), F.col("text"))
        return self.table("chunks").select("document_id", "chunk_index", "text", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "document_id", "chunk_index").limit(k)

    # ---- sessions ----

    def session_log(self, session_id: str) -> DataFrame:
        """A session's messages with their index, in order."""
        order = Window.partitionBy("session_id").orderBy("seq", "message_id")
        return self.table("messages").where(F.col("session_id") == session_id).withColumn("index", F.row_number().over(order) - 1)

    def recall(self, session_id: str, text: str, k: int = 10) -> DataFrame:
        """What contains a string: messages, then parts, then segments, the first k."""
        has = F.contains(F.lower("text"), F.lit(text.lower()))
        own = lambda name: self.table(name).where(F.col("session_id") == session_id)
        found = own("messages").where(has).select(F.lit(1).alias("rank"), "seq", F.concat(F.lit("message:"), "message_id").alias("ref"), "text")
        found = found.unionByName(own("parts").where(has).select(F.lit(2).alias("rank"), "seq", F.concat_ws(":", F.lit("part"), "message_id", F.col("part_index").cast("string")).alias("ref"), "text"))
        found = found.unionByName(own("segments").withColumnRenamed("summary", "text").where(has).select(F.lit(3).alias("rank"), "seq", F.concat(F.lit("segment:"), "segment_id").alias("ref"), "text"))
        return found.orderBy("rank", "seq", "ref").limit(k)

    def describe_item(self, item_id: str) -> DataFrame:
        return self.table("items").where(F.col("item_id") == item_id)

    def expand_segment(self, segment_id: str) -> DataFrame:
        """The messages that a segment sums up, each with how it was found."""
        ids = self.table("segments").where(F.col("segment_id") == segment_id).select("session_id", F.posexplode("lineage").alias("place", "message_id"))
        found = ids.join(self.table("messages"), ["session_id", "message_id"], "left")
        return found.select("place", "message_id", "text", F.when(F.col("seq").isNull(), "missing").otherwise("message_id").alias("recovered_from")).orderBy("place")

    def export(self, session_id: str) -> DataFrame:
        """Messages with their parts as arrays, and what each is in."""
        parts = self.table("parts").where(F.col("session_id") == session_id).groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("part_index", "part_type", "text", "status"))).alias("parts"))
        return self.session_log(session_id).join(parts, "message_id", "left").select("message_id", "index", "sender", "text", F.coalesce("parts", F.array().cast("array<struct<part_index:int,part_type:string,text:string,status:string>>")).alias("parts")).orderBy("index")

    def compact(self, tail: int = 8, size: int = 20) -> int:
        """Sum up all sessions' messages before their tail that no segment holds yet; the number of new segments.

        Messages of low value go into quarantined segments.  Compacting twice changes nothing."""
        done = self.table("segments").select("session_id", F.explode("lineage").alias("message_id"))
        newest = Window.partitionBy("session_id").orderBy(F.desc("seq"), F.desc("message_id"))
        rows = self.table("messages").withColumn("_age", F.row_number().over(newest)).where(F.col("_age") > tail).drop("_age")
        rows = rows.join(done, ["session_id", "message_id"], "left_anti").withColumn("quarantined", F.length(F.trim("text")) < LOW_VALUE)
        place = F.row_number().over(Window.partitionBy("session_id", "quarantined").orderBy("seq", "message_id")) - 1
        rows = rows.withColumn("chunk", F.floor(place / size))
        first = F.array_sort(F.collect_list(F.struct("seq", "message_id", "text")))
        made = rows.groupBy("session_id", "quarantined", "chunk").agg(first.alias("m")).withColumn("lineage", F.transform("m", lambda x: x["message_id"]))
        ident = F.concat(F.lit("seg:"), F.sha1(F.concat_ws("|", "session_id", F.array_join("lineage", ","))))
        made = made.select(ident.alias("segment_id"), "session_id", "chunk", F.element_at("m", -1)["seq"].alias("seq"), F.substring(F.array_join(F.transform("m", lambda x: x["text"]), " "), 1, 200).alias("summary"), "lineage", "quarantined")
        return self.upsert("segments", made)["inserted"]

    def compaction_state(self) -> DataFrame:
        held = self.table("segments").groupBy("session_id").agg(F.count_if(~F.col("quarantined")).alias("segments"), F.count_if("quarantined").alias("quarantined"))
        counts = self.table("messages").groupBy("session_id").agg(F.count("*").alias("messages"))
        return counts.join(held, "session_id", "left").select("session_id", "messages", F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("quarantined", F.lit(0)).alias("quarantined"))

    # ---- promotion ----

    def promote(self) -> int:
        """Sentences of summaries become patterns; equal ones fold into one with all their sources."""
        units = self.table("segments").where("not quarantined").select("segment_id", "seq", F.explode(F.split("summary", r"[.\n]+")).alias("unit"))
        units = units.select("segment_id", "seq", normalised(F.col("unit")).alias("unit")).where(F.length("unit") >= 20)
        made = units.groupBy("unit").agg(F.max("seq").alias("seq"), F.count("*").alias("reuse_count"), F.array_sort(F.collect_set("segment_id")).alias("provenance"))
        made = made.select(F.concat(F.lit("prom:proposition:"), F.substring(F.sha1("unit"), 1, 16)).alias("pattern_id"), "seq", F.col("unit").alias("text"), F.lit(0.7).alias("confidence"), "reuse_count", "provenance")
        return self.upsert("patterns", made)["inserted"]

    def promoted_search(self, text: str, k: int = 8) -> DataFrame:
        score = rank.overlap_ratio(F.lit(text), F.col("text"))
        return self.table("patterns").withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "pattern_id").limit(k)

    def promoted_get(self, pattern_id: str) -> DataFrame:
        return self.table("patterns").where(F.col("pattern_id") == pattern_id)

    # ---- context ----

    def assemble_context(self, session_id: str, query: str, intent: str = lx.OTHER_INTENT, budget: int = 1400, reserved: int = 256, tail: int = 8, k: int = 8) -> DataFrame:
        """Chosen and dropped hits for a query of one session: fresh tail, older messages, summaries, patterns, chunks."""
        log = self.session_log(session_id)
        n = F.count("*").over(Window.partitionBy("session_id"))
        log = log.withColumn("lane", F.when(F.col("index") >= n - tail, "fresh_tail").otherwise("episodic")).withColumn("recency", (F.col("index") + 1) / n)
        hits = log.select("lane", F.concat(F.lit("message:"), "message_id").alias("id"), F.lit("message").alias("memory_type"), "text", "recency")
        own = self.table("segments").where((F.col("session_id") == session_id) & ~F.col("quarantined"))
        more = [own.select(F.lit("session_summary").alias("lane"), F.col("segment_id").alias("id"), F.lit("summary").alias("memory_type"), F.col("summary").alias("text")), self.promoted_search(query, k).select(F.lit("promoted").alias("lane"), F.col("pattern_id").alias("id"), F.lit("promoted_fact").alias("memory_type"), "text"), self.query(query, k).select(F.lit("corpus").alias("lane"), F.concat_ws(":", F.lit("chunk"), "document_id", F.col("chunk_index").cast("string")).alias("id"), F.lit("corpus_chunk").alias("memory_type"), "text")]
        for m in more:
            hits = hits.unionByName(m.withColumn("recency", F.lit(0.3)))
        lexical = rank.overlap_ratio(F.lit(query), F.col("text"))
        best = Window.partitionBy("lane").orderBy(F.desc("lexical_score"), F.desc("recency"), "id")
        hits = hits.where("text is not null").withColumn("lexical_score", lexical).withColumn("_n", F.row_number().over(best)).where((F.col("_n") <= 2 * k) | (F.col("lane") == "fresh_tail"))
        lanes = lx.LANES[intent]
        index = F.array_position(F.array(*map(F.lit, lanes)), F.col("lane")) - 1
        zero = [F.lit(0.0).alias(c) for c in ("freshness_score", "novelty_score", "contradiction_risk")]
        none = [F.lit(None).cast("string").alias(c) for c in ("cluster_id", "claim_key", "claim_value")]
        hits = hits.select(F.lit(0).cast("long").alias("query_id"), F.lit(query).alias("query"), F.xxhash64("id").alias("ord"), "id", "lane", F.when(index >= 0, index).alias("lane_index"), "memory_type", "text", F.greatest(F.lit(1), F.floor((F.length("text") + 3) / 4)).cast("int").alias("tokens"), "lexical_score", F.greatest(F.lit(0.0), F.col("lexical_score") - 0.1).alias("semantic_score"), F.lit(0.65).alias("trust_score"), F.col("recency").alias("recency_score"), *zero, *none, F.lit(False).alias("must_include"), (F.col("lane") != "fresh_tail").alias("compressible"), F.lit(True).alias("has_provenance"))
        ranked = rank.rerank(hits).withColumn("ord", F.col("place"))
        return select.select_context(ranked, intent, budget, reserved)
