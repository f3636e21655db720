"""Merkle proofs against a plain tree, and places in groups against plain counting."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from lorewell.llm.merkle import manifest, row_hash, verified_rows
from lorewell.llm.ordered import in_order

from . import fixtures

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, pos int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(hashes):
    """The root, and for each hash its sibling runs and how to fold another one."""
    paths = [[] for _ in hashes]
    below = [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        runs = [range(i, min(i + 16, len(hashes))) for i in range(0, len(hashes), 16)]
        for run in runs:
            for i in run:
                for leaf in below[i]:
                    paths[leaf].append(([hashes[j] for j in run if j < i], [hashes[j] for j in run if j > i]))
        below = [[leaf for i in run for leaf in below[i]] for run in runs]
        hashes = [sha(*(hashes[i] for i in run)) for run in runs]
    return hashes[0], paths


def brute(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        found = sorted(sources[s], key=lambda x: x[:3])
        trees[s] = (found, *climb([x[2] for x in found]))
    root, tops = climb([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        found, subroot, paths = trees[s]
        for (_, _, leaf, row), path in zip(found, paths):
            path = path + top
            h = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                h = leaf_of((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for before, after in path:
                h = sha(*before, h, *after)
            out.append((row[0], leaf, subroot, root, sha(*(x for pair in path for run in pair for x in run)), h, h == root))
    return sorted(out, key=str)


def rows():
    rng = random.Random(13)
    out = [(rng.randrange(400), "hot", "en", 3, f"Text {rng.randrange(50)}") for _ in range(700)]
    out += [(i, f"s{i % 23}", None, None, "A" * (i % 4)) for i in range(90)]
    out += [(None, None, "é", 0, None), (None, "hot", None, None, ""), (5, "", "de", 1, "ÄB"), (5, "é", "de", 1, "ÄB"), (10, "only", "x", 2, "Long " * 9000)]
    return out + out[:40] + [out[0]] * 300


def test_proofs_equal_a_plain_tree(spark):
    made = rows()
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in made], SCHEMA).repartition(7)
    assert sorted(map(tuple, verified_rows(docs).collect()), key=str) == brute(made)


def test_few_rows(spark):
    for some in ([], rows()[:1], rows()[:2], rows()[698:702], [(i, "a", None, None, "X") for i in range(17)], [(i, "a", None, None, "X") for i in range(257)]):
        docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in some], SCHEMA)
        assert sorted(map(tuple, verified_rows(docs).collect()), key=str) == (brute(some) if some else [])


def test_fixture_documents_and_manifest(spark):
    docs = fixtures.docs(spark)
    found = verified_rows(docs)
    assert found.count() == docs.count() and found.where("not verified").count() > 0
    made = manifest(docs.select("doc_id", "source", row_hash(F.col("text")).alias("leaf")))
    assert {r.source for r in made.sources.collect()} == {"src", None} and len(made.root) == 64
    other = manifest(docs.where("doc_id is not null").select("doc_id", "source", row_hash(F.col("text")).alias("leaf")))
    assert other.root != made.root


def test_places_and_sums_over_partitions(spark):
    rng = random.Random(4)
    data = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), i, rng.randrange(-(1 << 63), 1 << 63)) for i in range(3000)]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else one partition takes all of so small a table
    try:
        got = {r.i: (r.pos, r.v) for r in in_order(spark.createDataFrame(data, "g long, i long, v long"), ["g"], ["i"], ["v"]).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    state = {}
    for g, i, v in data:
        n, total = state.get(g, (0, 0))
        state[g] = (n + 1, total := (total + v) % (1 << 64))
        assert got[i][0] == n and got[i][1] % (1 << 64) == total
