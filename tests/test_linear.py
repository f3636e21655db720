"""Linear searches against brute force, in one block and in many."""

import random
import tracemalloc

import numpy as np
import pytest

from lorewell.operators import linear
from lorewell.operators.linear import linear_top_k


def table(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", *(f"w{i}" for i in range(30))]
    return [(i, f"n{i * 7 % n}", None if i % 17 == 0 else [rng.choice(words[: rng.randint(1, 32)]) for _ in range(rng.randint(0, 12))], (i % 5) / 4, i % 9 + 1.0, i % 11) for i in range(n)]


@pytest.mark.parametrize("block,above", [(10**6, 0.0), (40, 0.0), (10**6, -1.0)])
def test_equals_brute_force(spark, monkeypatch, block, above):
    monkeypatch.setattr(linear, "MATRIX_QUERIES", 3)
    monkeypatch.setattr(linear, "MATRIX_VALUES", 64)
    rows, rng = table(1, 300), random.Random(2)
    asks = [(q, rng.sample(["the", "of", "w1", "w2", "w3", "w29", "none"], rng.randint(0, 5))) for q in range(12)]
    asks = [(q, fs, [float(rng.randint(1, 3)) for _ in fs]) for q, fs in asks]
    got = linear_top_k(spark.createDataFrame(rows, "row_id long, tie string, features array<string>, base double, norm double, skip long").repartition(4), spark.createDataFrame(asks, "query_id long, features array<string>, weights array<double>"), 7, above, block=block)
    want = []
    for q, fs, ws in asks:
        scored = [(round(base + sum(w * (r or []).count(f) for f, w in zip(fs, ws)), 9), tie, i) for i, tie, r, base, _, skip in rows if skip != q]
        want += [(q, i, s, tie) for s, tie, i in sorted([x for x in scored if x[0] > above], key=lambda x: (-x[0], x[1]))[:7]]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_shape_finish_and_empty(spark):
    rows = spark.createDataFrame([(1, 1, ["a", "b"], 2.0), (2, 2, ["a", "c", "d"], 3.0)], "row_id long, tie long, features array<string>, norm double")
    asks = spark.createDataFrame([(9, ["a", "c"])], "query_id long, features array<string>")
    got = linear_top_k(rows, asks, 5, finish=lambda s, n, q: s / (n + q - s)).collect()
    assert [(r.row_id, r.score) for r in sorted(got)] == [(1, round(1 / 3, 9)), (2, round(2 / 3, 9))]
    assert linear_top_k(rows, asks, 5, shape=lambda c, n: c / n).count() == 2
    assert linear_top_k(rows.limit(0), asks, 5).count() == 0 and linear_top_k(rows, asks.limit(0), 5).count() == 0


@pytest.mark.parametrize("kind", [int, str])
def test_many_equal_hits_take_little_memory(kind):
    rng = np.random.default_rng(5)
    scores = rng.integers(0, 3, (2_000, 200)).astype(np.float64)  # two thirds of all pairs are hits, most of them equal
    ids = rng.permutation(2_000)
    ties = ids if kind is int else np.array([f"{i:038}" for i in ids])
    best = linear.Best(200, 5, 0.0)
    tracemalloc.start()
    best.add(scores, ids, ties)
    query, score, tie, found = best.compact()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < (12 << 20 if kind is int else 40 << 20)
    for q in range(200):
        want = sorted(((-scores[i, q], ids[i]) for i in range(2_000) if scores[i, q] > 0))[:5]
        assert [(-s, i) for s, i in zip(score[query == q], found[query == q])] == want
