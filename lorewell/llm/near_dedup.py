"""Near-duplicate documents by min-max hashing: signatures, banding, confirmed links, components.

Each hash function orders a document's shingles; the least and the greatest both are kept, so a signature of 2h values
costs h evaluations, and each value agrees for two documents with probability equal to their Jaccard similarity.
Bands of `rows` values give bucket keys; the number of bands follows from the threshold and the probability `miss` of
losing a pair that is exactly at it.

Equal sets are one class and only classes go on.  In each bucket every class is tried against one hub, the class whose
buckets are the fullest, so a group of n near copies costs n trials.  What then still lies in another component than its
bucket's hub meets all of the bucket's other components: no candidate pair is passed over but for those whose two sides
are linked already and those that an exact bound rules out.  The bound: sets are hashed to the parities of SKETCH bins, and
one element that only one of two sets has changes one parity, so the parities that differ never outnumber the elements
that differ.  What remains is confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_text, text_key, written
from .textvec import mixed, set_class, shingle_sets

ROWS = 6
#: Pairs for which one copy of a class's text is dealt out.
PAIRS_A_COPY = 5_000
#: Nodes that a task holds when it folds its links.
FOREST_NODES = 200_000
#: Bins of the parity sketch, in words of 64 bits.
SKETCH_WORDS = 16


def bands_for(threshold: float, miss: float, rows: int = ROWS) -> int:
    """Bands with which a pair of this similarity shares no bucket with a probability of at most `miss`."""
    return max(1, math.ceil(math.log(miss) / math.log(1 - threshold**rows)))


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def min_max(sets: list[np.ndarray], count: int) -> np.ndarray:
    """Signatures of non-empty sets: for each of `count` functions the minimum, then the maximum."""
    x = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    out = np.empty((len(sets), 2 * count), dtype=np.uint64)
    for j, (a, b) in enumerate(zip(*_functions(count))):
        v = x * a + b
        out[:, 2 * j] = np.minimum.reduceat(v, begins)
        out[:, 2 * j + 1] = np.maximum.reduceat(v, begins)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket key for each document and band."""
    weights = np.random.default_rng(11).integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    v = mixed(signatures[:, : bands * rows].reshape(-1, bands, rows))
    return mixed((v * weights).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each bin whether an odd number of hashes falls into it, as 64-bit words."""
    odd = (np.bincount((hashes >> np.uint64(64 - 10)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def features(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """Per row (doc_id, text, text_key): doc_id, text_key, n_shingles, cls (name of the set; null if it is empty), keys
    (one for each band), sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                sets = list(shingle_sets((t.encode("utf-8") for t in part["text"]), k))
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                if full:
                    own = band_keys(min_max([sets[i] for i in full], -(-bands * rows // 2)), bands, rows).view(np.int64)
                    for i, row in zip(full, own):
                        keys[i] = row
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "text_key": part["text_key"].to_numpy(), "n_shingles": [len(s) for s in sets], "cls": [set_class(s) if len(s) else None for s in sets], "keys": keys, "sketch": [parities(s) if len(s) else None for s in sets]})

    return docs.mapInPandas(run, "doc_id long, text_key binary, n_shingles long, cls binary, keys array<long>, sketch array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, share: Fraction) -> DataFrame:
    """The pairs (a, b) of classes whose sets have intersection >= share * union.  texts: cls, text."""
    # A class that many are tried against has its text in as many copies as make PAIRS_A_COPY pairs for each.
    copies = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_COPY).cast("int").alias("copies"))
    of_a = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")).join(copies, "a").select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    dealt = pairs.join(copies, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("salt"))
    own = dealt.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b").join(of_a, ["a", "salt"])
    num, den = share.numerator, share.denominator

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = (None, None)
        for pdf in batches:
            keep = []
            for a, text_a, text_b in zip(pdf["a"], pdf["text_a"], pdf["text_b"]):
                if last[0] != a:
                    last = (a, next(shingle_sets([text_a.encode("utf-8")], k)))
                x, y = last[1], next(shingle_sets([text_b.encode("utf-8")], k))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a", "b"]]

    return own.mapInPandas(run, "a binary, b binary")


def forests(edges: DataFrame, most: int = FOREST_NODES) -> DataFrame:
    """Edges (u, v) with the same components, each partition's own ones as stars around their least node.

    A partition is folded `most` nodes at a time, so that what a task holds doesn't grow with it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def top(x: object) -> object:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def stars() -> pd.DataFrame:
            below = [x for x in parent if parent[x] != x]
            return pd.DataFrame({"u": below, "v": [top(x) for x in below]})

        for pdf in batches:
            for u, v in zip(pdf["u"], pdf["v"]):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                a, b = top(u), top(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                if len(parent) > most:
                    yield stars()
                    parent.clear()
        yield stars()

    return edges.mapInPandas(run, edges.schema)


def components(links: DataFrame, most: int = FOREST_NODES) -> DataFrame:
    """(node, root) for the nodes of undirected links (a, b): forests within partitions, then alternating large and small
    stars until every node has one edge, to its component's least node.

    Every round is a written table; edges never exceed the links in number, and no task holds a node's neighbours.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", True)
    read, edges = edges, written(forests(edges, most).distinct(), "forests", True)
    discard(read)

    def unfinished(df: DataFrame) -> bool:
        ends = df.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(df.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        ends = ends.groupBy("node").agg(F.sum("below").alias("below"), F.sum("above").alias("above"))
        return bool(ends.where("below > 1 or (below > 0 and above > 0)").limit(1).count())

    while unfinished(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        read, edges = edges, written(small, "small", True)
        discard(read)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8, miss: float = 1e-7, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """Per row of a table: doc_id, n_shingles, component_id, kept; with_key: text_key too, which tells rows of one id apart.

    Words are runs without ASCII white space, A-Z lower-cased.  Documents whose shingle sets have a Jaccard similarity of
    at least `threshold` are linked; component_id is the smallest id of those reachable over links, kept whether it is
    the row's own.  A null, empty or wordless text has no shingles and is linked with nothing.  Repeated rows each get
    the same result; rows of one id with different texts are linked by their own texts.  A null id never names a
    component that has another id.  An empty table gives an empty result; other columns are not kept.
    """
    share = Fraction(threshold).limit_denominator(10_000)
    bands = bands_for(threshold, miss)
    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("text_key", text_key())
    feat = written(features(rows, k, bands, ROWS), "features")
    whole = feat.where("cls is not null")
    classes = written(whole.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "text_key")).alias("one"), *(F.first(c).alias(c) for c in ("n_shingles", "keys", "sketch"))), "classes")

    # Buckets with more than one class: counted with partial sums, then joined, which Spark splits where a key is hot.
    keyed = classes.select("cls", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = keyed.join(sizes, "key").join(classes.select("cls", F.col("n_shingles").alias("n")), "cls")
    members = written(members, "members", True)
    degree = members.groupBy("cls").agg(F.sum("size").alias("degree"))
    ranked = members.join(degree, "cls")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "cls", "n")).alias("hub")).select("key", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n"))
    hubs = written(hubs, "hubs", True)

    num, den = share.numerator, share.denominator
    near = lambda m, n: F.least(m, n) * den >= F.greatest(m, n) * num  # noqa: E731  else the sizes alone rule the link out

    trial = members.join(hubs, "key").where(F.col("cls") != F.col("hub")).where(near(F.col("n"), F.col("hub_n")))
    first = written(trial.select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct(), "first", True)

    # One text of each class in a bucket, that of its representative row; equal rows give it more than once.
    wanted = members.select("cls").distinct().join(classes.select("cls", "one"), "cls")
    same = F.col("one.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("one.text_key") == F.col("text_key"))
    texts = written(rows.join(wanted, same).select("cls", "text"), "texts", True)
    if texts.groupBy("cls").count().where("count > 1").limit(1).count():
        texts = written(texts.groupBy("cls").agg(F.min("text").alias("text")), "texts")

    links = written(confirmed(first, texts, k, share), "links", True)
    root = components(links)

    # Those that their bucket's hub did not reach, against the bucket's other components.
    placed = members.join(root.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    placed = placed.join(hubs, "key").select("key", "cls", "n", "root", "hub")
    mixed_keys = placed.groupBy("key").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("key")
    placed = placed.join(mixed_keys, "key", "left_semi").join(classes.select("cls", "sketch"), "cls")
    placed = written(placed.select("key", "cls", "n", "root", "hub", *(F.get("sketch", i).alias(f"s{i}") for i in range(SKETCH_WORDS))), "mixed", True)
    hub_root = placed.where("cls = hub").select("key", F.col("root").alias("hub_root"))
    words = range(SKETCH_WORDS)
    apart = placed.join(hub_root, "key").where("root <> hub_root").select("key", F.col("cls").alias("x"), F.col("n").alias("xn"), F.col("root").alias("xr"), *(F.col(f"s{i}").alias(f"x{i}") for i in words))
    other = placed.where("cls <> hub").select("key", F.col("cls").alias("y"), F.col("n").alias("yn"), F.col("root").alias("yr"), *(F.col(f"s{i}").alias(f"y{i}") for i in words))
    differ = reduce(lambda p, q: p + q, (F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in words))
    # Linked sets differ in at most (1 - share) of their union, which is at most the smaller one's size / share.
    possible = (F.col("xr") != F.col("yr")) & near(F.col("xn"), F.col("yn")) & (differ * num <= (den - num) * F.least("xn", "yn"))
    second = apart.join(other, (apart["key"] == other["key"]) & possible).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = written(second.join(tried, ["a", "b"], "left_anti"), "second", True)
    more = written(confirmed(second, texts, k, share), "links", True)
    if more.limit(1).count():
        root = components(links.unionByName(more))

    named = classes.select("cls", F.col("doc_id").alias("least_id")).join(root.withColumnRenamed("node", "cls"), "cls")
    ids = named.groupBy("root").agg(F.min("least_id").alias("component"))
    joined = named.select("cls", "root").join(ids, "root").select("cls", "component")
    own = classes.select("cls", F.col("doc_id").alias("least_id")).join(joined, "cls", "left").select("cls", F.coalesce("component", "least_id").alias("component"))
    out = feat.select("doc_id", "n_shingles", "cls", "text_key").join(own, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), *(["text_key"] if with_key else []))
