"""Lanes whose candidates are all rows, with or without a word in common with the query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linear import Finish, linear_top_k
from .rank import overlap_ratio, words

#: Scores that a lane gives its hits whatever the query.
CORPUS = {"recency_score": 0.35, "freshness_score": 0.6, "trust_score": 0.75, "novelty_score": 0.5}
LARGE_FILE = {"recency_score": 0.4, "freshness_score": 0.55, "trust_score": 0.72, "novelty_score": 0.5}
FRESH_TAIL = {"freshness_score": 0.95, "trust_score": 0.8, "novelty_score": 0.35}
EPISODIC = {"freshness_score": 0.7, "trust_score": 0.8, "novelty_score": 0.4}
LEAST_SEMANTIC, LEAST_RECENCY = 0.2, 0.05


def share(sums: np.ndarray, norm: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words in common, as a share of the query's."""
    return sums / np.maximum(sizes, 1)


def jaccard(sums: np.ndarray, norm: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Words in common, as a share of those that either has; norm: the row's words."""
    return sums / np.maximum(norm + sizes - sums, 1)


def overlap_lane(queries: DataFrame, rows: DataFrame, prefix: str, k: int) -> DataFrame:
    """The best rows of each query: query_id, doc_id, text, lexical_score, semantic_score; rows: doc_id, text.

    All rows with a text are candidates, those without a common word too; equal ones go by name (prefix and id, as text)."""
    rows = rows.where("text <> ''")
    name = F.concat(F.lit(prefix), F.col("doc_id").cast("string"))
    found = linear_top_k(rows.select(F.col("doc_id").alias("row_id"), name.alias("tie"), words(F.col("text")).alias("features")), queries.select("query_id", words(F.col("query")).alias("features")), k, above=-1.0, finish=share)
    found = found.select("query_id", F.col("row_id").alias("doc_id"), F.col("score").alias("lexical_score"), F.greatest(F.lit(LEAST_SEMANTIC), "score").alias("semantic_score"))
    return found.join(rows.select("doc_id", "text"), "doc_id").select("query_id", "doc_id", "text", "lexical_score", "semantic_score")


def message_search(queries: DataFrame, messages: DataFrame, k: int, digits: int = 6, finish: Finish | None = None) -> DataFrame:
    """(query_id, session_id, message_id, score): the k messages with the most words in common with a query, by `finish`.

    queries: query_id, features; messages: session_id, message_id (not negative), features.  Messages without a common
    word are no hits; equal ones go by session and message."""
    place = F.concat(*(F.lpad(F.col(c).cast("string"), 19, "0") for c in ("session_id", "message_id")))
    rows = messages.select(F.xxhash64("session_id", "message_id").alias("row_id"), place.alias("tie"), "features", F.size("features").alias("norm"))
    found = linear_top_k(rows, queries, k, digits=digits, finish=finish)
    return found.select("query_id", F.substring("tie", 1, 19).cast("long").alias("session_id"), F.substring("tie", 20, 19).cast("long").alias("message_id"), "score")


def bm25(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, floor: float = 0.25, digits: int = 4) -> DataFrame:
    """(query_id, doc_id, score): Okapi BM25; queries: query_id, features; docs: doc_id, words (with repeats).

    An idf below 0 counts as `floor` of the mean idf.  Document frequencies come from all documents; scores above 0, ties
    by the larger doc_id."""
    st = docs.agg(F.count("*").alias("docs"), F.avg(F.greatest(F.size("words"), F.lit(0))).alias("mean")).first()
    df = docs.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = df.select("word", (F.log(st["docs"] - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = F.lit(idf.agg(F.avg("idf")).first()[0])
    asked = queries.select("query_id", F.explode("features").alias("word")).join(idf, "word").withColumn("idf", F.when(F.col("idf") < 0, mean * floor).otherwise(F.col("idf")))
    asked = asked.groupBy("query_id").agg(F.collect_list("word").alias("features"), F.collect_list("idf").alias("weights"))
    average = st["mean"] or 1.0
    rows = docs.select(F.col("doc_id").alias("row_id"), (-F.col("doc_id")).alias("tie"), F.col("words").alias("features"), F.size("words").alias("norm"))
    found = linear_top_k(rows, asked, k, digits=digits, shape=lambda tf, n: tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / average)))
    return found.select("query_id", F.col("row_id").alias("doc_id"), "score")


def episodic_lane(queries: DataFrame, messages: DataFrame, tail: int = 8, k: int = 20) -> DataFrame:
    """A session's messages for the queries that are asked in it: query_id, session_id, message_id, text, lane, the scores,
    must_include, place.

    queries: query_id, session_id, query; messages: session_id, message_id (in the order of the session), text.  The last
    `tail` messages must be included and come first in their order; then the older ones, the latest first, until there
    are k.  Messages without a text are no hits, but count as places.  A query without words overlaps with nothing."""
    own = messages.join(queries.select("session_id").distinct(), "session_id", "left_semi")
    session = Window.partitionBy("session_id")
    placed = own.withColumn("back", F.row_number().over(session.orderBy(F.col("message_id").desc()))).withColumn("n", F.count("*").over(session))
    fresh = F.col("back") <= tail
    rec = F.when(fresh, 1 - (F.col("back") - 1) / F.least("n", F.lit(tail))).otherwise(F.greatest(F.lit(LEAST_RECENCY), 1 - (F.col("back") - tail) / (F.col("n") - tail + 1)))
    placed = placed.withColumn("must_include", fresh).withColumn("recency_score", rec).where("text <> ''")
    name = F.concat_ws(":", F.lit("episodic"), F.col("session_id").cast("string"), F.col("message_id").cast("string"))
    order = [F.col("must_include").desc(), F.when(F.col("must_include"), -F.col("back")), F.col("recency_score").desc(), name]
    kept = placed.withColumn("place", F.row_number().over(session.orderBy(*order))).where(F.col("place") <= k)
    found = kept.join(queries.select("query_id", "session_id", "query"), "session_id").withColumn("o", overlap_ratio(F.col("query"), F.col("text")))
    must = F.col("must_include")
    lexical = F.least(F.lit(1.0), F.when(must, 0.3).otherwise(0.2) + F.col("o"))
    semantic = F.least(F.lit(1.0), F.when(must, 0.4 + F.col("o") * 0.8).otherwise(0.3 + F.col("o") * 0.7))
    fixed = [F.when(must, FRESH_TAIL[c]).otherwise(EPISODIC[c]).alias(c) for c in EPISODIC]
    return found.select("query_id", "session_id", "message_id", "text", F.when(must, "fresh_tail").otherwise("episodic").alias("lane"), lexical.alias("lexical_score"), semantic.alias("semantic_score"), "recency_score", "must_include", F.col("place").cast("long").alias("place"), *fixed)
