"""Vector search behind one interface: exact cosine, an inverted-file index, token overlap as the default.

The index fits its centroids on a bounded sample and assigns every row to the list of its nearest one.  A search looks
into the lists nearest to a query.  Lists and the queries that ask them are cut into pieces, so that a list with a large
share of all rows, or of all queries, is many groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lanes import jaccard
from .linear import Best, linear_top_k
from .rank import top_k, words

#: Queries that go out at once; rows that the centroids are fitted on; rows of a list's piece, and queries that ask it at once.
VECTORS_AT_ONCE, SAMPLE, PIECE_ROWS, PIECE_QUERIES = 10_000, 20_000, 20_000, 2_000
MOST_LISTS = 4096
_HIT = "query_id long, row_id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1.0)


def _by_length(ids: np.ndarray, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of each length: those of different lengths can't be compared."""
    sizes = np.array([len(v) for v in vectors])
    return {int(n): (ids[sizes == n], unit(np.array([v for v in vectors if len(v) == n], np.float64))) for n in np.unique(sizes) if n}


def _known(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col("embedding").isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), "embedding")


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 5, block: int = VECTORS_AT_ONCE) -> DataFrame:
    """(query_id, vec_id, score): of each query the k vectors of all with the highest cosine, ties by vec_id.

    vectors: vec_id, embedding; queries: query_id, embedding.  A vector is not its own neighbour; cosines are rounded to
    `digits` before they are compared, and one with a vector of length 0 is 0.  Null and empty embeddings and null ids are
    left out, and vectors of different numbers of values aren't compared.  Queries go out a block at a time."""
    from lorewell.streaming.ingest import shared_path

    spark = vectors.sparkSession
    rows, asked = _known(vectors, "vec_id"), _known(queries, "query_id")
    number = -(-asked.count() // block)
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, number))))

    def searched(found: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(_by_length(np.array([r[0] for r in found], np.int64), [r[1] for r in found]))  # at most about `block` vectors

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = sent.value
            best = {n: Best(len(ids), k, -np.inf) for n, (ids, _) in parts.items()}
            for pdf in batches:
                for n, (own, v) in _by_length(pdf["vec_id"].to_numpy(np.int64), pdf["embedding"].tolist()).items():
                    if n not in parts:
                        continue
                    ids, q = parts[n]
                    step = max(1, 4_000_000 // len(ids))
                    for low in range(0, len(own), step):
                        s = np.round(v[low : low + step] @ q.T, digits)
                        s[own[low : low + step][:, None] == ids] = -np.inf
                        best[n].add(s, own[low : low + step], own[low : low + step])
            for n, held in best.items():
                got = held.compact()
                if got is not None:
                    query, score, _, row = got
                    yield pd.DataFrame({"query_id": parts[n][0][query], "row_id": row, "score": score})

        return top_k(rows.mapInPandas(run, _HIT), ["query_id"], [F.col("score").desc(), F.col("row_id")], k).withColumnRenamed("row_id", "vec_id")

    if number <= 1:
        found = asked.drop("_block").collect()
        return searched(found) if found else spark.createDataFrame([], _HIT.replace("row_id", "vec_id"))
    out = shared_path(spark, "nearest") + uuid.uuid4().hex
    for i in range(number):  # one block's queries on the driver and in the tasks at a time
        found = asked.where(F.col("_block") == i).drop("_block").collect()
        if found:
            searched(found).write.mode("append").parquet(out)
    return spark.read.schema(_HIT.replace("row_id", "vec_id")).parquet(out)


@dataclass(frozen=True)
class IvfIndex:
    """centroids: unit vectors, one for each list; rows: (list, piece, vec_id, embedding) of every row, written."""

    centroids: np.ndarray
    rows: DataFrame


def _clusters(x: np.ndarray, n: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means of unit vectors; a list that loses all its rows keeps its centroid."""
    rng = np.random.default_rng(seed)
    found = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        near = (x @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, x)
        found = np.where((np.bincount(near, minlength=n) > 0)[:, None], unit(sums), found)
    return found


def ivf_index(vectors: DataFrame, n_lists: int | None = None, sample: int = SAMPLE, rounds: int = 10, seed: int = 0) -> IvfIndex:
    """An index of all rows (vec_id, embedding): centroids from the `sample` rows with the smallest hash of id and vector.

    n_lists: about the root of the number of rows, MOST_LISTS at most, if it isn't given.  All vectors that count have as
    many values as most of the sample's; others aren't indexed (nor would they be compared)."""
    from lorewell.streaming.ingest import shared_path

    spark = vectors.sparkSession
    rows = _known(vectors, "vec_id").where(F.size("embedding") > 0)
    n = rows.count()
    some = rows.withColumn("h", F.xxhash64("vec_id", "embedding")).orderBy("h", "vec_id").limit(sample).collect()
    if not some:
        return IvfIndex(np.zeros((0, 0)), spark.createDataFrame([], "list int, piece int, vec_id long, embedding array<float>"))
    sizes = pd.Series([len(r["embedding"]) for r in some]).mode()
    width = int(sizes.max())
    x = unit(np.array([r["embedding"] for r in some if len(r["embedding"]) == width], np.float64))
    lists = min(n_lists or max(1, int(np.sqrt(n))), MOST_LISTS, len(x))
    centroids = _clusters(x, lists, rounds, seed)
    sent = spark.sparkContext.broadcast(centroids)  # MOST_LISTS vectors at most

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = np.concatenate([(unit(np.stack(part).astype(np.float64)) @ sent.value.T).argmax(axis=1) for part in np.array_split(pdf["embedding"].to_numpy(), -(-len(pdf) // 2000))]) if len(pdf) else np.zeros(0)
            yield pdf.assign(list=near.astype(np.int32))

    kind = dict(rows.dtypes)["embedding"]
    found = rows.where(F.size("embedding") == width).mapInPandas(assigned, f"vec_id long, embedding {kind}, list int")
    path = shared_path(spark, "ivf")
    found.write.parquet(path)
    found = spark.read.parquet(path)
    sizes = F.broadcast(found.groupBy("list").agg(F.ceil(F.count("*") / PIECE_ROWS).cast("int").alias("pieces")))  # MOST_LISTS rows at most
    return IvfIndex(centroids, found.join(sizes, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int").alias("piece"), "vec_id", "embedding"))


def ivf_search(index: IvfIndex, queries: DataFrame, k: int, probes: int = 8, digits: int = 5) -> DataFrame:
    """(query_id, vec_id, score) of the k nearest vectors in the `probes` lists nearest to each query, as nearest_vectors
    gives them of all; what the other lists hold is missed.  With as many probes as lists nothing is."""
    spark = queries.sparkSession
    if not len(index.centroids):
        return spark.createDataFrame([], _HIT.replace("row_id", "vec_id"))
    probes, width = min(probes, len(index.centroids)), index.centroids.shape[1]
    sent = spark.sparkContext.broadcast(index.centroids)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near = np.argsort(-(unit(np.stack(pdf["embedding"].to_numpy()).astype(np.float64)) @ sent.value.T), axis=1, kind="stable")[:, :probes]
                yield pdf.assign(list=near.astype(np.int32).tolist())

    asked = _known(queries, "query_id").where(F.size("embedding") == width)
    asked = asked.mapInPandas(routed, f"query_id long, embedding {dict(asked.dtypes)['embedding']}, list array<int>").withColumn("list", F.explode("list"))
    per_list = asked.groupBy("list").agg(F.ceil(F.count("*") / PIECE_QUERIES).cast("int").alias("asks"))  # MOST_LISTS rows at most, as the next
    pieces = index.rows.groupBy("list").agg((F.max("piece") + 1).alias("pieces"))
    sizes = F.broadcast(per_list.join(pieces, "list"))
    q = asked.join(sizes, "list").withColumn("ask", F.pmod(F.xxhash64("query_id"), F.col("asks")).cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    v = index.rows.join(sizes.select("list", "asks"), "list").withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
    keys = ["list", "piece", "ask"]

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "row_id": [], "score": []}).astype({"query_id": "int64", "row_id": "int64", "score": "float64"})
        ids, own = left["query_id"].to_numpy(np.int64), right["vec_id"].to_numpy(np.int64)
        a, b = (unit(np.stack(x["embedding"].to_numpy()).astype(np.float64)) for x in (left, right))
        best = Best(len(ids), k, -np.inf)
        for low in range(0, len(own), 1000):
            s = np.round(b[low : low + 1000] @ a.T, digits)
            s[own[low : low + 1000][:, None] == ids] = -np.inf
            best.add(s, own[low : low + 1000], own[low : low + 1000])
        query, score, _, row = best.compact() or (np.zeros(0, np.int64), np.zeros(0), None, np.zeros(0, np.int64))
        return pd.DataFrame({"query_id": ids[query], "row_id": row, "score": score})

    hits = q.select(*keys, "query_id", "embedding").groupBy(*keys).cogroup(v.select(*keys, "vec_id", "embedding").groupBy(*keys)).applyInPandas(scored, _HIT)
    return top_k(hits, ["query_id"], [F.col("score").desc(), F.col("row_id")], k).withColumnRenamed("row_id", "vec_id")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits that were found; 1 where there are none."""
    keys = ["query_id", "vec_id"]
    r = exact.select(*keys).join(found.select(*keys, F.lit(1).alias("hit")), keys, "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
    return 1.0 if r is None else float(r)


class VectorBackend(Protocol):
    """Finds records (record_id, tie, text, embedding, source_type) for queries (query_id, text, embedding)."""

    name: str

    def search(self, records: DataFrame, queries: DataFrame, k: int) -> DataFrame: ...


class TokenJaccard:
    """Words in common as a share of all words of both; ties by `tie`."""

    name = "token_jaccard_v1"

    def search(self, records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        rows = records.select(F.col("record_id").alias("row_id"), "tie", words(F.col("text")).alias("features")).withColumn("norm", F.size("features"))
        found = linear_top_k(rows, queries.select("query_id", words(F.col("text")).alias("features")), k, finish=jaccard)
        return found.select("query_id", F.col("row_id").alias("record_id"), "score")


class ExactCosine:
    """Cosine against all records that have a vector."""

    name = "cosine_exact"

    def search(self, records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return nearest_vectors(records.select(F.col("record_id").alias("vec_id"), "embedding"), queries, k).withColumnRenamed("vec_id", "record_id")


class InvertedFile:
    """Cosine in the nearest lists of an index that is made for the search."""

    name = "cosine_ivf"

    def __init__(self, probes: int = 8):
        self.probes = probes

    def search(self, records: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        index = ivf_index(records.select(F.col("record_id").alias("vec_id"), "embedding"))
        return ivf_search(index, queries, k, self.probes).withColumnRenamed("vec_id", "record_id")


DEFAULT_BACKEND = TokenJaccard.name
BACKENDS: dict[str, VectorBackend] = {b.name: b for b in (TokenJaccard(), ExactCosine(), InvertedFile())}


def semantic_search(records: DataFrame, queries: DataFrame, k: int, backend: str | None = None, source_type: str | None = None) -> DataFrame:
    """(query_id, record_id, score, requested_backend, selected_backend, fallback_used, place): by a backend's name.

    An unknown name falls back to the default, and the rows say so.  source_type keeps only records of that source."""
    requested = backend or DEFAULT_BACKEND
    chosen = BACKENDS.get(requested, BACKENDS[DEFAULT_BACKEND])
    kept = records if source_type is None else records.where(F.col("source_type") == source_type)
    found = chosen.search(kept, queries, k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "record_id"))
    return found.select("query_id", "record_id", "score", F.lit(requested).alias("requested_backend"), F.lit(chosen.name).alias("selected_backend"), F.lit(requested != chosen.name).alias("fallback_used"), place.cast("long").alias("place"))
