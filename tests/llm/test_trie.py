"""The trie of conversation prefixes against plain dictionaries, and the succinct form by itself."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from lorewell.llm import trie
from lorewell.llm.trie import ConversationTrie, Louds, key_bytes, prefix_rollups

SCHEMA = "conv_id long, turn long, role string, text string, label string, p1 int, pos int"


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            label = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, role, label), (role, text)))
    convs = {c: [t for _, t in sorted(ts)] for c, ts in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids = {}
    for node in members:
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        saves = (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = leaves.get(node, 0) or 1
        saved[node] = saved.get(node, 0) + saves
        if node:
            leaves[node[:-1]] = leaves.get(node[:-1], 0) + leaves[node]
            saved[node[:-1]] = saved.get(node[:-1], 0) + saved[node]
    digest = {n: hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest() for n in members}
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids.get(n, 0), leaves[n], saved[n], digest[n]) for n, m in members.items()), key=str)


def data():
    rng = random.Random(12)
    words = ["a b", "c  d\te", "", None, "é ü", "\x1cx"]
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(words)) for c in range(150) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", "same first words" if t == 0 else f"x{t}") for c in range(200, 420) for t in range(4)]  # copies
    rows += [(7000, None, "r", "early"), (7000, 3, "r", "b"), (7000, 3, "r", "a"), (7000, 3, "r", "a"), (None, 1, "r", "nobody's"), (43, 9, "", "tail"), (9961, 0, "only", "one")]
    rows += [(8000, t, "long", f"turn {t % 7}") for t in range(900)] + [(8001, t, "long", f"turn {t % 7}") for t in range(950)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("least", [2, 40, 10**6])
def test_rollups_equal_dictionaries(spark, monkeypatch, least):
    monkeypatch.setattr(trie, "PIECE_TURNS", 100)
    monkeypatch.setattr(trie, "PIECE_IDS", 16)
    monkeypatch.setattr(trie, "SHARD_NODES", 300)
    rows = data()
    table = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(6)
    assert sorted(map(tuple, prefix_rollups(table, least).collect()), key=str) == brute(rows)


def test_few_rows(spark):
    for rows in ([], [(None, 1, "a", "b")], [(0, 1, "a", "b c")], [(5, None, None, None)], [(-3, 1, "a", "b"), (-20, 1, "x", "y z")]):
        assert sorted(map(tuple, prefix_rollups(spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)).collect()), key=str) == (brute(rows) if rows else [])


def test_shards_are_tries(spark):
    rows = data()
    found = ConversationTrie(spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA), 40)
    shards = found.shards().collect()
    assert sum(s.n_nodes for s in shards) == found.n_forest > 0
    for s in shards:
        made = Louds(np.unpackbits(np.frombuffer(s.bits, np.uint8), count=2 * s.n_nodes + 1, bitorder="little"), np.frombuffer(s.labels, "S16"))
        for i in range(s.n_nodes):
            assert made.child(int(made.parent[i]), bytes(made.labels[i])) == i
            kids = range(int(made.begins[i]), int(made.begins[i]) + int(made.n_children[i]))
            assert all(made.parent[k] == i and s.n_convs[k] <= s.n_convs[i] for k in kids)


def test_level_order_by_hand():
    #  tops x, y; x has a, b; b has c
    keys = key_bytes(np.arange(1, 6), np.zeros(5, np.int64))  # c, y, b, x, a
    parents = key_bytes(np.array([3, 99, 4, 98, 4]), np.zeros(5, np.int64))
    made, order = Louds.built(keys, parents, np.array([2, 0, 1, 0, 1]), np.array([b"c", b"y", b"b", b"x", b"a"], "S16"))
    assert made.bits.tolist() == [1, 1, 0, 1, 1, 0, 0, 0, 1, 0, 0]
    assert made.labels.tolist() == [b"x", b"y", b"a", b"b", b"c"] and made.parent.tolist() == [-1, -1, 0, 0, 3]
    assert made.child(3, b"c") == 4 and made.child(-1, b"y") == 1 and made.child(0, b"c") == -1
    assert made.rolled_up(np.ones(5, np.int64), np.array([0, 0, 1, 1, 2])).tolist() == [4, 1, 1, 2, 1]
