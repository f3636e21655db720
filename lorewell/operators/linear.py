"""Exact top-k searches where a row's score for a query is a weighted sum over features that both have.

Features are strings: words, tokens, values of a column.  A stated set of queries goes out in blocks of bounded size; a
task turns a batch of rows into a matrix over the block's features, and one matrix product scores all rows of the batch
for all queries.  A task keeps the k best rows of each query, and only those are shuffled: a word that every row has is a
full column, not a key that all rows meet at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import top_k

#: Features of a block's queries, counted once for each query: what is broadcast at once, some 40 MB at most.
BLOCK_FEATURES = 500_000
#: Distinct features and queries of one matrix, and values of a matrix of rows.
MATRIX_FEATURES, MATRIX_QUERIES, MATRIX_VALUES = 16_000, 2_000, 1_000_000
#: Hits that are gathered before all but the best are dropped.
MOST_HITS = 50_000


@dataclass
class Part:
    """Queries that share one matrix: weights of (feature, query) and (phrase, query), and each query's number of features."""

    ids: np.ndarray
    vocabulary: pa.Array
    weights: np.ndarray
    sizes: np.ndarray
    phrases: list[str]
    phrase_weights: np.ndarray


def _weights(found: list[tuple[list[str], list[float] | None]]) -> tuple[list[str], np.ndarray]:
    names = list(dict.fromkeys(f for fs, _ in found for f in fs or ()))
    place = {f: i for i, f in enumerate(names)}
    weights = np.zeros((len(names), len(found)))
    for j, (fs, ws) in enumerate(found):
        np.add.at(weights, ([place[f] for f in fs or ()], j), 1.0 if ws is None else ws)
    return names, weights


def parts_of(rows: list[tuple]) -> list[Part]:
    """Matrices for queries (id, features, weights or None, phrases or None, their weights or None)."""
    out, some, seen = [], [], set()

    def close() -> None:
        names, weights = _weights([r[1:3] for r in some])
        phrases, phrase_weights = _weights([r[3:5] for r in some])
        out.append(Part(np.array([r[0] for r in some], np.int64), pa.array(names, pa.string()), weights, np.array([len(r[1]) for r in some], np.float64), phrases, phrase_weights))

    for r in rows:
        fresh = seen.union(r[1])
        if some and (len(fresh) > MATRIX_FEATURES or len(some) == MATRIX_QUERIES):
            close()
            some, fresh = [], set(r[1])
        some.append(r)
        seen = fresh
    if some:
        close()
    return out


class Best:
    """The k best rows of each query so far: by score, then by `tie`, the smallest first."""

    def __init__(self, n: int, k: int, above: float):
        self.k, self.held = k, []
        self.least = np.full(n, above)
        self.full = np.zeros(n, bool)
        self.pending = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> None:
        """scores: (rows, queries).  A score at the bound counts only once k are held, where a tie may still win."""
        good = (scores > self.least) | (self.full & (scores == self.least))
        if len(scores) > 1 and np.count_nonzero(good) > MOST_HITS:  # the best of the one half bound the other
            half = len(scores) // 2
            self.add(scores[:half], ids[:half], ties[:half])
            self.compact()
            self.add(scores[half:], ids[half:], ties[half:])
            return
        row, query = np.nonzero(good)
        if len(row):
            self.held.append((query, scores[row, query], ties[row], ids[row]))
            self.pending += len(row)
            if self.pending > MOST_HITS + 2 * self.k * len(self.least):
                self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        if not self.held:
            return None
        query, score, tie, ids = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((tie, -score, query))
        query, score, tie, ids = query[order], score[order], tie[order], ids[order]
        begins = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
        last = place == self.k - 1
        self.least[query[last]], self.full[query[last]] = score[last], True
        kept = place < self.k
        self.held = [(query[kept], score[kept], tie[kept], ids[kept])]
        self.pending = int(kept.sum())
        return self.held[0]


def matrix_of(features: pa.ListArray, values: np.ndarray | None, vocabulary: pa.Array) -> np.ndarray:
    """Rows by features of the vocabulary: the sum of a row's values of each (its count, without values)."""
    codes = pc.fill_null(pc.index_in(features.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(features), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(features)), lengths)
    known = codes >= 0
    at = row[known] * len(vocabulary) + codes[known]
    weights = None if values is None else values[known]
    return np.bincount(at, weights, minlength=len(features) * len(vocabulary)).reshape(len(features), len(vocabulary)).astype(np.float64, copy=False)


#: Turns counts (rows, features) and the rows' `norm` into what is weighted.
Shape = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Turns sums (rows, queries), the rows' `norm` and the queries' numbers of features into scores.
Finish = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def linear_top_k(rows: DataFrame, queries: DataFrame, k: int, above: float = 0.0, digits: int = 9, shape: Shape | None = None, finish: Finish | None = None, block: int = BLOCK_FEATURES) -> DataFrame:
    """(query_id, row_id, score, tie): of each query the k rows with the highest score above `above`, ties by `tie`.

    rows: row_id (long), tie (string or long), features (strings), base (added to the sum; 0 if absent), norm (a number for
    shape and finish; 0 if absent), skip (a query_id that the row doesn't answer; optional).  queries: query_id (long),
    features, and weights (else each counts 1); phrases and phrase_weights (optional) count where the rows' `text` holds
    the phrase.  Scores are rounded to `digits` before they are compared.  Null or empty
    features have a sum of 0; queries without features too.  Repeated rows count each; empty tables give nothing."""
    spark = rows.sparkSession
    have = set(rows.columns)
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), "tie", "features", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in ("base", "norm")), F.col("skip").cast("long").alias("skip") if "skip" in have else F.lit(None).cast("long").alias("skip"), *(("text",) if "phrases" in queries.columns else ()))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("features", F.expr("cast(array() as array<string>)")).alias("features"), F.col("weights") if "weights" in queries.columns else F.lit(None).cast("array<double>").alias("weights"), *(F.col(c) if c in queries.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("phrases", "array<string>"), ("phrase_weights", "array<double>"))))
    total = asked.agg(F.sum(F.size("features") + F.coalesce(F.greatest(F.size("phrases"), F.lit(0)), F.lit(0)) + 1)).first()[0] or 0
    number = -(-total // block) if total else 0
    dealt = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, number))))
    tie_type = dict(rows.dtypes)["tie"]
    schema = f"query_id long, row_id long, score double, tie {tie_type}"

    def searched(found: list[tuple]) -> DataFrame:
        sent = spark.sparkContext.broadcast(parts_of(found))  # at most about `block` features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: list[Part] = sent.value
            best = [Best(len(p.ids), k, above) for p in parts]
            for batch in batches:
                for p, held in zip(parts, best):
                    step = max(1, MATRIX_VALUES // max(len(p.vocabulary), len(p.ids), 1))
                    for low in range(0, batch.num_rows, step):
                        some = batch.slice(low, step)
                        ids, ties = some.column(0).to_numpy(zero_copy_only=False), some.column(1).to_numpy(zero_copy_only=False)
                        base, norm = some.column(3).to_numpy(), some.column(4).to_numpy()
                        counts = matrix_of(some.column(2), None, p.vocabulary)
                        if shape is not None:
                            counts = shape(counts, norm[:, None])
                        scores = counts @ p.weights
                        if finish is not None:
                            scores = finish(scores, norm[:, None], p.sizes)
                        if p.phrases:
                            holds = [pc.fill_null(pc.match_substring(some.column(6), x), False).to_numpy(zero_copy_only=False) for x in p.phrases]
                            scores = scores + np.stack(holds, axis=1).astype(np.float64) @ p.phrase_weights
                        scores = np.round(scores + base[:, None], digits)
                        skip = some.column(5)
                        if skip.null_count < len(skip):
                            scores[pc.fill_null(skip, -1).to_numpy(zero_copy_only=False)[:, None] == np.where(p.ids == -1, -2, p.ids)] = -np.inf
                        held.add(scores, ids, ties.astype(str) if ties.dtype == object else ties)
            for p, held in zip(parts, best):
                got = held.compact()
                if got is not None:
                    query, score, tie, ids = got
                    yield pa.RecordBatch.from_arrays([pa.array(p.ids[query]), pa.array(ids), pa.array(score), pa.array(tie.tolist(), pa.string() if tie_type == "string" else pa.int64())], ["query_id", "row_id", "score", "tie"])

        hits = rows.mapInArrow(run, schema)
        return top_k(hits, ["query_id"], [F.col("score").desc(), F.col("tie")], k)

    if number <= 1:
        found = [tuple(r) for r in asked.collect()]
        return searched(found) if found else spark.createDataFrame([], schema)
    from lorewell.streaming.ingest import shared_path

    out = shared_path(spark, "linear") + uuid.uuid4().hex
    for i in range(number):  # one block's queries on the driver and in the tasks at a time
        found = [tuple(r)[:5] for r in dealt.where(F.col("_block") == i).collect()]
        if found:
            searched(found).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
