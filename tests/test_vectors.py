"""Vector searches against brute force, and the index' recall."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.operators import vectors
from lorewell.operators.vectors import ivf_index, ivf_search, nearest_vectors, recall, semantic_search

SF = "/root/testdata/sf0.01"


def brute(rows, asks, k):
    out = []
    for q, a in asks:
        scored = []
        for i, v in rows:
            if i is not None and v and len(v) == len(a) and i != q:
                x, y = np.array(a), np.array(v)
                size = np.sqrt((x * x).sum() * (y * y).sum())
                scored.append((-round(float(x @ y / size) if size else 0.0, 5), i))
        out += [(q, i, -s) for s, i in sorted(scored)[:k]]
    return sorted(out)


def data():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8 if i % 11 else 5).round(3).tolist()) for i in range(200)]
    return rows + [(500, [0.0] * 8), (501, [1.0] * 8), (502, [1.0] * 8), (503, None), (504, []), (None, [1.0] * 8)]


@pytest.mark.parametrize("block", [10_000, 7])
def test_exact_search(spark, block):
    rows = data()
    asks = [r for r in rows if r[0] is not None and r[1] and r[0] % 5 == 0]
    got = nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(asks, "query_id long, embedding array<double>"), 4, block=block)
    assert sorted((r.query_id, r.vec_id, round(r.score, 5) + 0.0) for r in got.collect()) == brute(rows, asks, 4)


def test_index_with_all_probes_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE_ROWS", 20)
    monkeypatch.setattr(vectors, "PIECE_QUERIES", 5)
    rows = [r for r in data() if r[1] and len(r[1]) == 8 and r[0] is not None]
    rows += [(1000 + i, [1.0] * 8) for i in range(100)]  # copies: one list holds a third of all rows
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = [r for r in rows if r[0] % 4 == 0]
    index = ivf_index(table, n_lists=6)
    assert index.rows.count() == len(rows) and index.rows.groupBy("list", "piece").count().agg(F.max("count")).first()[0] < 60
    got = ivf_search(index, spark.createDataFrame(asks, "query_id long, embedding array<double>"), 4, probes=6)
    assert sorted((r.query_id, r.vec_id, round(r.score, 5) + 0.0) for r in got.collect()) == brute(rows, asks, 4)
    assert ivf_search(ivf_index(table.limit(0)), table.withColumnRenamed("vec_id", "query_id"), 4).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
def test_recall_of_the_index(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = recall(ivf_search(ivf_index(rows), queries, 5, 16), nearest_vectors(rows, queries, 5))
    print("recall", found)
    assert found >= 0.9


def test_backends(spark):
    records = spark.createDataFrame([(1, 1, "a b c", [1.0, 0.0], "x"), (2, 2, "a", [0.0, 1.0], "y"), (3, 3, "z", [1.0, 1.0], "x")], "record_id long, tie long, text string, embedding array<double>, source_type string")
    queries = spark.createDataFrame([(9, "a b", [1.0, 0.1])], "query_id long, text string, embedding array<double>")
    got = semantic_search(records, queries, 5).orderBy("place").collect()
    assert [(r.record_id, round(r.score, 3), r.fallback_used) for r in got] == [(1, 0.667, False), (2, 0.5, False)]
    assert [(r.record_id, r.selected_backend, r.fallback_used) for r in semantic_search(records, queries, 5, "none such", "y").collect()] == [(2, "token_jaccard_v1", True)]
    for name in ("cosine_exact", "cosine_ivf"):
        assert [r.record_id for r in semantic_search(records, queries, 2, name).orderBy("place").collect()] == [1, 3]
