"""A trie of conversation prefixes: how many conversations share their first turns, and what sharing them would save.

A node is a distinct sequence of first turns.  Its key is the sum, modulo 2**64 and twice, of hashes of (turn, place):
sums run along conversations of any length, over partitions (see ordered.py), and two different sequences share a key
with a probability of about 2**-128.  Nodes come from one aggregation, so shared prefixes count once from then on.

Three kinds of nodes are rolled up apart:

* heavy upper levels, nodes with at least `heavy_from` members.  That bound is a share of all rows, so there are at most
  HEAVY_MOST of them, few enough to broadcast and for one task;
* light subtrees below them, dealt to shards by the hash of their top.  A shard is a succinct level-order trie: numpy
  builds its LOUDS bits and its labels, and totals go from the last level to the first by np.add.at;
* tails, where one conversation is left: their values are known without a walk, however long they are.

Totals of light subtrees and tails then merge into the heavy levels, which are rolled up as one more such trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .ordered import in_order, wrapped_sum

#: Most heavy nodes (some 60 bytes each), and the least members of one in a small table.
HEAVY_MOST = 200_000
HEAVY_LEAST = 64
#: Nodes of a shard, about; turns of a conversation that are joined in one piece; ids in one piece of a digest's text.
SHARD_NODES = 200_000
PIECE_TURNS = 10_000
PIECE_IDS = 4096
#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def key_bytes(first: np.ndarray, second: np.ndarray) -> pa.Array:
    """Pairs of long as 16 bytes each."""
    both = np.ascontiguousarray(np.stack((first, second), axis=1).astype("<i8"))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(first), [None, pa.py_buffer(both.tobytes())])


class Louds:
    """A forest in level order: bits has a run of ones for the tops and for each node's children, each run with a zero after it."""

    def __init__(self, bits: np.ndarray, labels: np.ndarray):
        self.bits, self.labels = bits, labels
        ones = np.flatnonzero(bits)
        #: Zeros before a node's one: the number of its parent, one more as the tops' run comes first.
        self.parent = ones - np.arange(len(ones)) - 1
        ends = np.flatnonzero(bits == 0)
        self.n_children = np.diff(ends, prepend=-1)[1:] - 1
        self.begins = ends[:-1] - np.arange(len(ends) - 1)  # ones before a node's run: its first child
        self.tops = int(ends[0]) if len(ends) else 0

    @classmethod
    def built(cls, keys: pa.Array, parents: pa.Array, level: np.ndarray, labels: np.ndarray) -> tuple[Louds, np.ndarray]:
        """From nodes in any order, each with its key, its parent's (absent for tops) and its level; also where each place's node was."""
        up = pc.fill_null(pc.index_in(parents, value_set=keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        up[level == 0] = -1
        n = len(level)
        place, order, done = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        by_level = np.argsort(level, kind="stable")
        for some in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1) if n else ():
            above = np.where(up[some] >= 0, place[up[some]], -1)
            some = some[np.lexsort((labels[some], above))]
            place[some] = np.arange(done, done + len(some))
            order[done : done + len(some)] = some
            done += len(some)
        above = np.where(up[order] >= 0, place[up[order]], -1)
        runs = np.bincount(above + 1, minlength=n + 1)
        bits = np.ones(2 * n + 1, np.uint8)
        bits[np.cumsum(runs) + np.arange(n + 1)] = 0
        return cls(bits, labels[order]), order

    def child(self, node: int, label: bytes) -> int:
        """The child of a node (-1: of none, a top) with a label, or -1."""
        first, n = (0, self.tops) if node < 0 else (int(self.begins[node]), int(self.n_children[node]))
        label = np.bytes_(label.rstrip(b"\0"))  # as numpy keeps it
        at = first + int(np.searchsorted(self.labels[first : first + n], label))
        return at if at < first + n and self.labels[at] == label else -1

    def rolled_up(self, values: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Sums over subtrees, in place order: each level is added to the one above it, from the last."""
        total = values.copy()
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [len(level)]])
        for a, b in zip(bounds[-2:0:-1], bounds[:1:-1]):
            np.add.at(total, self.parent[a:b], total[a:b])
        return total


_ROLLED = "p1 long, p2 long, n_children long, n_leaves long, saved_tokens long"


def _shard(table: pa.Table) -> tuple[Louds, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The trie of a shard's rows, where each place's row was, levels in place order, and the columns."""
    v = {c: np.asarray(table.column(c)) for c in ("p1", "p2", "q1", "q2", "level", "n_convs", "words", "depth", "longest", "more_children", "more_leaves", "more_saved")}
    labels = np.array(table.column("label").to_pylist(), dtype="S16")
    trie, order = Louds.built(key_bytes(v["p1"], v["p2"]), key_bytes(v["q1"], v["q2"]), v["level"], labels)
    return trie, order, v["level"][order], v


def _rolled(table: pa.Table) -> pa.Table:
    """Children, leaves and savings of each node of one shard."""
    trie, order, level, v = _shard(table)
    n_children = trie.n_children + v["more_children"][order]
    alone = v["n_convs"][order] == 1
    n_children = np.where(alone, (v["depth"] < v["longest"])[order], n_children)
    leaves = trie.rolled_up((trie.n_children + v["more_children"][order] == 0) + v["more_leaves"][order], level)
    saved = trie.rolled_up((v["n_convs"][order] - 1) * v["words"][order] + v["more_saved"][order], level)
    return pa.table({"p1": v["p1"][order], "p2": v["p2"][order], "n_children": n_children.astype(np.int64), "n_leaves": leaves.astype(np.int64), "saved_tokens": saved.astype(np.int64)})


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, label, words) of each row with a conversation; null roles and texts as empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    label = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), label.alias("label"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of every twentieth one put before them: (conv_id, len) and (conv_id, depth, label, words, len).

    Conversation c gets the first h = crc32(c) % 4 turns of conversation c - c % 20, if that exists, and loses its own
    first h; c % 20 has the sign of c.  Own turns find their conversation's row in pieces, so a long conversation doesn't meet in one task.
    """
    rows = written(turns, "trie-turns").withColumn("copy", F.monotonically_increasing_id())
    placed = in_order(rows, ["conv_id"], ["turn", "role", "label", "copy"], name="trie-places").drop("copy", "turn", "role")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % 20
    head = F.array_sort(F.collect_list(F.struct("pos", "label", "words")))
    heads = placed.where("conv_id % 20 = 0 and pos < 3").groupBy(F.col("conv_id").alias("base")).agg(head.alias("head"))
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": h, "base": base}).join(heads, "base", "left")
    convs = convs.withColumn("head", F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))))
    convs = convs.withColumn("m", F.coalesce(F.size("head"), F.lit(0))).withColumn("m", F.greatest("m", F.lit(0)))
    convs = written(convs.withColumn("len", F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).drop("base"), "trie-conversations")
    first = convs.where("m > 0").select("conv_id", "len", F.explode("head").alias("t")).select("conv_id", (F.col("t.pos") + 1).alias("depth"), "t.label", "t.words", "len")
    pieces = convs.select("conv_id", "m", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PIECE_TURNS}"))).alias("piece"))
    own = placed.where(F.col("pos") >= h).withColumn("piece", F.expr(f"pos div {PIECE_TURNS}")).join(pieces, ["conv_id", "piece"])
    own = own.select("conv_id", (F.col("pos") - h + F.col("m") + 1).alias("depth"), "label", "words", "len")
    return convs.select("conv_id", "len"), first.unionByName(own)


def _minus(a: Column, b: Column) -> Column:
    return wrapped_sum(wrapped_sum(a, F.bitwise_not(b)), F.lit(1).cast("long"))


def _ends(members: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of rows (p1, p2, conv_id): the digest of a node's ids, ascending, joined by commas.

    Ranges of sorted ids become pieces of text; a node whose ids lie in one piece is hashed there, the pieces of others
    are hashed one after the other, by the piece.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, key, ids, runs, out = TaskContext.get().partitionId(), 0, None, [], 0, []

        def close(last: bool) -> None:
            nonlocal seq, ids
            text = ",".join(map(str, ids))
            # Whole: neither cut in pieces nor at an end of the partition.
            whole = last and runs > 1 and not cut
            out.append((*key, part, seq, text if not whole else None, hashlib.sha256(text.encode()).hexdigest() if whole else None))
            seq, ids = seq + 1, []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()))], ["p1", "p2", "part", "seq", "ids", "sha"])

        cut = False
        for batch in batches:
            for p1, p2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (p1, p2) != key:
                    if key is not None:
                        close(True)
                    key, runs, cut = (p1, p2), runs + 1, False
                elif len(ids) >= PIECE_IDS:
                    cut = True
                    close(False)
                ids.append(conv)
            if len(out) > 2000:
                yield batch_of()
        if key is not None:
            runs = 0  # the last run may go on in the next partition
            close(True)
        if out:
            yield batch_of()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for p1, p2, ids in zip(*(c.to_pylist() for c in batch.columns[:3])):
                if (p1, p2) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (p1, p2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["p1", "p2", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], ["p1", "p2", "sha"])

    dealt = members.select("p1", "p2", "conv_id").repartitionByRange("p1", "p2", "conv_id").sortWithinPartitions("p1", "p2", "conv_id")
    pieces = written(dealt.mapInArrow(packed, "p1 long, p2 long, part int, seq long, ids string, sha string"), "trie-ends")
    more = pieces.where("sha is null").select("p1", "p2", "ids", "part", "seq").repartition("p1", "p2").sortWithinPartitions("p1", "p2", "part", "seq")
    more = more.mapInArrow(hashed, "p1 long, p2 long, sha string")
    return pieces.where("sha is not null").select("p1", "p2", "sha").unionByName(more).withColumnRenamed("sha", "ends_sha256")


def _forest(nodes: DataFrame, paths: DataFrame, heavy: DataFrame) -> DataFrame:
    """Light nodes that several conversations share, and the tops of tails below them, with top (its key) and level."""
    tops = paths.join(heavy.select(F.col("p1").alias("q1"), F.col("p2").alias("q2")), ["q1", "q2"], "left_semi").join(heavy.select("p1", "p2"), ["p1", "p2"], "left_anti")
    tops = tops.select(F.col("conv_id"), F.col("p1").alias("t1"), F.col("p2").alias("t2"), F.col("depth").alias("top_depth"))
    return nodes.where("not heavy and parent_n > 1 and not (n_convs = 1 and parent_heavy)").join(tops, "conv_id").withColumn("level", F.col("depth") - F.col("top_depth"))


def _sharded(forest: DataFrame, n_nodes: int) -> DataFrame:
    zero = F.lit(0).cast("long")
    rows = forest.withColumns({"more_children": zero, "more_leaves": zero, "more_saved": zero, "shard": F.pmod(F.xxhash64("t1", "t2"), F.lit(max(1, n_nodes // SHARD_NODES)))})
    return rows.groupBy("shard")


class ConversationTrie:
    """Nodes of a table's conversations (conv_id, turn, role, text), each once.

    Rows without a conv_id belong to no conversation and aren't members of anything.  Rows of equal turns are ordered by
    role, then by a hash of role and text; a repeated row is one more turn.  An empty table has no nodes.  Other columns
    don't count.
    """

    def __init__(self, conversations: DataFrame, heavy_least: int = HEAVY_LEAST, heavy_most: int = HEAVY_MOST):
        lengths, rows = rebuilt(turns_of(conversations))
        terms = {f"a{k}": F.xxhash64(F.lit(k), "label", "depth") for k in (1, 2)}
        rows = rows.withColumns(terms).withColumns({"p1": F.col("a1"), "p2": F.col("a2")})
        paths = in_order(rows, ["conv_id"], ["depth"], ["p1", "p2"], name="trie-paths")
        self.paths = paths.withColumns({"q1": _minus(F.col("p1"), F.col("a1")), "q2": _minus(F.col("p2"), F.col("a2"))}).drop("a1", "a2", "pos")
        zero = F.lit(0).cast("long")
        self.members = self.paths.where("depth = len").select("p1", "p2", "conv_id").unionByName(lengths.where("len = 0").select(zero.alias("p1"), zero.alias("p2"), "conv_id"))
        found = self.paths.groupBy("p1", "p2").agg(F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.min("label").alias("label"), F.min("depth").alias("depth"), F.min("words").alias("words"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("len").alias("longest"))
        root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("len").alias("longest")).where("n_convs > 0")
        none = F.lit(None).cast("long")
        root = root.select(zero.alias("p1"), zero.alias("p2"), none.alias("q1"), none.alias("q2"), F.lit(b"").alias("label"), zero.alias("depth"), zero.alias("words"), "n_convs", "conv_id", "longest")
        plain = written(found.unionByName(root), "trie-nodes")
        total = plain.agg(F.sum("n_convs")).first()[0] or 0
        #: Nodes with so many members are heavy; their number is at most total / heavy_from, and the root.
        self.heavy_from = max(heavy_least, -(-total // heavy_most))
        heavy = (F.col("n_convs") >= self.heavy_from) | (F.col("depth") == 0)
        plain = plain.withColumn("heavy", heavy)
        self.heavy = F.broadcast(plain.where("heavy").select("p1", "p2", "conv_id", "n_convs"))
        # Parents: heavy ones, which may have many children, by the bounded broadcast; light ones have fewer than heavy_from.
        up = self.heavy.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"), F.lit(True).alias("parent_heavy"))
        first = plain.join(up, ["q1", "q2"], "left")
        light = plain.where("not heavy").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"), F.lit(False).alias("parent_heavy"))
        rest = first.where("parent_n is null and depth > 0").drop("parent_conv_id", "parent_n", "parent_heavy").join(light, ["q1", "q2"])
        self.nodes = written(first.where("parent_n is not null or depth = 0").unionByName(rest), "trie-parents")
        self.forest = written(_forest(self.nodes, self.paths, self.heavy), "trie-forest")
        self.n_forest = self.forest.count()

    def shards(self) -> DataFrame:
        """The light subtrees as succinct tries: shard, n_nodes, bits (LOUDS, packed, lowest first), labels (16 bytes each) and members of each node."""

        def pack(table: pa.Table) -> pa.Table:
            trie, order, _, v = _shard(table)
            return pa.table({"shard": [table.column("shard")[0].as_py()], "n_nodes": [len(order)], "bits": [np.packbits(trie.bits, bitorder="little").tobytes()], "labels": [trie.labels.tobytes()], "n_convs": [v["n_convs"][order]]})

        return _sharded(self.forest, self.n_forest).applyInArrow(pack, "shard long, n_nodes long, bits binary, labels binary, n_convs array<long>")

    def rollups(self) -> DataFrame:
        """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
        nodes, keys = self.nodes, ["p1", "p2"]
        rolled = written(_sharded(self.forest, self.n_forest).applyInArrow(_rolled, _ROLLED), "trie-rolled")
        tails = nodes.where("not heavy and n_convs = 1 and (parent_n = 1 or parent_heavy)")
        tails = tails.select(*keys, (F.col("depth") < F.col("longest")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        light = rolled.unionByName(tails)
        # What hangs below each heavy node, summed before it gets there.
        below = nodes.where("parent_heavy and not heavy").select(*keys, "q1", "q2").join(light, keys).groupBy("q1", "q2")
        below = below.agg(F.count("*").alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        upper = nodes.where("heavy").join(below.withColumnsRenamed({"q1": "p1", "q2": "p2"}), keys, "left").na.fill(0, ["more_children", "more_leaves", "more_saved", "q1", "q2"])
        upper = upper.withColumn("level", F.col("depth")).groupBy(F.lit(0).alias("all")).applyInArrow(_rolled, _ROLLED)
        out = nodes.join(light.unionByName(upper), keys).join(_ends(self.members), keys, "left")
        return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def prefix_rollups(conversations: DataFrame, heavy_least: int = HEAVY_LEAST) -> DataFrame:
    """Every prefix node of a table's rebuilt conversations, with its members, children, leaves and savings."""
    return ConversationTrie(conversations, heavy_least).rollups()
