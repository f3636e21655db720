"""A Merkle manifest of a dataset, with proofs from the preimages of each leaf's ancestors.

Leaves are hashes of whole rows.  Each source has a tree over its leaves, and one tree stands over the sources' roots.
For each parent the hashes of its children are stored, joined in order: its preimage.  A leaf joins the preimages of
its ancestors; in each its own branch has a slot of 64 characters.  Cut out of the preimage, what is left are the
siblings of the proof; another hash put there gives the parent's new hash, and so on up to the root.

Trees are built level by level, a parent from at most ARITY children, so a source may hold any share of all rows: places
come from ranges of (source, id), and no group is larger than a parent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .ordered import in_order

#: Children of a parent.
ARITY = 16
#: Fixed value: characters of a hash.
SLOT = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def row_hash(*columns: Column) -> Column:
    """Hash of a row: each value as its length in bytes, a colon and its text, or a dash for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _single(level: DataFrame) -> Column:
    """Whether a parent stands for the only node that a tree has left: that node is the tree's root, and isn't hashed again."""
    return (F.col("up") == 0) & (F.col("n") == 1)


def climb(nodes: DataFrame, keep: tuple[str, ...]) -> list[DataFrame]:
    """Written levels of parents of nodes (tree, pos, hash), each (tree, up, n, preimage); the first has its children.

    The last level holds only trees that have a single node left.
    """
    levels: list[DataFrame] = []
    while not levels or not nodes.isEmpty():
        kids = F.array_sort(F.collect_list(F.struct("pos", "hash", *(keep if not levels else ()))))
        level = nodes.groupBy("tree", F.expr(f"pos div {ARITY}").alias("up")).agg(kids.alias("kids"))
        preimage = F.array_join(F.transform("kids", lambda k: k["hash"]), "")
        level = level.select("tree", "up", F.size("kids").alias("n"), preimage.alias("preimage"), *(() if levels else ("kids",)))
        levels.append(written(level, "merkle-level"))
        nodes = levels[-1].where(~_single(levels[-1])).select("tree", F.col("up").alias("pos"), F.sha2("preimage", 256).alias("hash"))
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, hash) of each tree's root."""
    out = None
    for level in levels:
        some = level.where(_single(level)).select("tree", F.col("preimage").alias("hash"))
        out = some if out is None else out.unionByName(some)
    return out


def _entry(preimage: str, place: str) -> Column:
    return F.struct(F.col(preimage).alias("preimage"), F.expr(f"int({place} % {ARITY})").alias("slot"))


def descend(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The children of the first level, each with path: (preimage, slot) of its ancestors from its parent to the top.

    above: (tree, top, path) continues each tree from its root; a row of each parent's path goes down to its children,
    which are at most ARITY, so no join has a hot key.
    """
    paths = None
    for level in reversed(levels):
        ends = level.where(_single(level)).join(above, "tree").withColumn("end", F.lit(True))
        if paths is not None:
            own = _entry("upper_preimage", "up")
            rest = level.where(~_single(level)).withColumn("upper", F.expr(f"up div {ARITY}")).join(paths, ["tree", "upper"])
            rest = rest.withColumn("path", F.when(F.col("upper_end"), F.col("path")).otherwise(F.concat(F.array(own), F.col("path"))))
            ends = ends.unionByName(rest.select(*level.columns, "top", "path").withColumn("end", F.lit(False)))
        paths = ends.select("tree", F.col("up").alias("upper"), F.col("preimage").alias("upper_preimage"), F.col("end").alias("upper_end"), "top", "path")
    kids = ends.select("tree", "preimage", "end", "top", "path", F.explode("kids").alias("kid")).select("tree", "preimage", "end", "top", "path", "kid.*")
    own = _entry("preimage", "pos")
    return kids.withColumn("path", F.when(F.col("end"), F.col("path")).otherwise(F.concat(F.array(own), F.col("path")))).drop("preimage", "end")


def fold(hash_: Column, path: Column) -> Column:
    """The root that a hash leads to: put in its slot of each preimage in turn."""
    return F.aggregate(path, hash_, lambda h, e: F.sha2(F.overlay(e["preimage"], h, e["slot"] * SLOT + 1, F.lit(SLOT)), 256))


def siblings(path: Column) -> Column:
    """The hashes of all siblings, level by level and from left to right, as one text."""
    return F.array_join(F.transform(path, lambda e: F.overlay(e["preimage"], F.lit(""), e["slot"] * SLOT + 1, F.lit(SLOT))), "")


@dataclass
class Manifest:
    """root: the dataset's hash, None for an empty table; sources: (source, subroot, path to the root); leaves: (doc_id,
    source, leaf, subroot, path, and the kept columns)."""

    root: str | None
    sources: DataFrame
    leaves: DataFrame


def manifest(rows: DataFrame, keep: tuple[str, ...] = ()) -> Manifest:
    """Trees over rows (doc_id, source, leaf, kept columns): by source and id (nulls first, repeated ids by leaf)."""
    key = F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit("-"))  # null sorts first
    leaves = written(rows.withColumn("tree", key), "merkle-leaves").withColumn("copy", F.monotonically_increasing_id())
    placed = in_order(leaves, ["tree"], ["doc_id", "leaf", "copy"], name="merkle-places").withColumnRenamed("leaf", "hash")
    levels = climb(placed, ("doc_id", *keep))
    tops = in_order(roots(levels).select(F.lit(0).alias("all"), "tree", "hash"), ["all"], ["tree"], name="merkle-sources")
    upper = climb(tops.select(F.lit(0).alias("tree"), "pos", "hash", F.col("tree").alias("source_key")), ("source_key",))
    root = roots(upper).first()
    nothing = F.expr("cast(array() as array<struct<preimage: string, slot: int>>)")
    spark = rows.sparkSession
    start = spark.range(1).select(F.lit(0).alias("tree"), F.lit(root["hash"] if root else None).alias("top"), nothing.alias("path"))
    sources = written(descend(upper, start).select(F.col("source_key").alias("tree"), F.col("hash").alias("top"), "path"), "merkle-paths")
    source = F.when(F.col("tree") != "-", F.substring("tree", 2, 1 << 30)).alias("source")
    out = descend(levels, sources)
    return Manifest(root["hash"] if root else None, sources.select(source, F.col("top").alias("subroot"), "path"), out.select("doc_id", source, F.col("hash").alias("leaf"), F.col("top").alias("subroot"), "path", *keep))


def verified_rows(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    tampered: the text that someone else would have in a row's place (of the columns doc_id, source, lang, n_chars,
    text), null where nobody changed it.  By default every fifth row by its id's crc32 has A-Z in lower case.  Rows
    without an id aren't tampered with; null values and empty texts have hashes of their own; repeated rows are leaves
    each; an empty table gives no rows; other columns don't count.
    """
    if tampered is None:
        tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", UPPER, LOWER))
    rows = docs.select(*FIELDS).withColumn("changed_text", tampered)
    fields = [F.col(c) for c in FIELDS]
    changed = F.when(F.col("changed_text").isNotNull(), row_hash(*fields[:-1], F.col("changed_text")))
    made = manifest(rows.select("doc_id", "source", row_hash(*fields).alias("leaf"), changed.alias("changed")), ("changed",))
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    out = made.leaves.select("doc_id", "leaf", "subroot", F.lit(made.root).cast("string").alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
