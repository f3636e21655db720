"""Folding of reasoning patterns: equal ones become one, near ones are linked to a canonical one."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.streaming.ingest import shared_path

from .skew import join_by_share

#: Ratio from which a pattern is linked, words of the near fingerprint.
RATIO, NEAR_WORDS = 0.93, 24
#: Earlier patterns that a pattern is compared with in its own row; the others of its bucket follow in cells.
CANDIDATES = 4
#: Patterns that become Python objects at once.
AT_ONCE = 100
#: Patterns of either side that meet in one cell, about.
BLOCK = 100
#: Texts that can be alike are in one band of lengths or in neighbouring ones; a little wide, as it is a rounded logarithm.
BAND = math.log((2 - RATIO) / RATIO) * 1.001


def fingerprints(rows: DataFrame, text: str = "text") -> DataFrame:
    """exact_fp of the normalised text, near_fp of its first distinct words in order."""
    norm = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    near = F.array_join(F.slice(F.array_sort(F.array_distinct(F.filter(F.split(norm, " "), lambda t: t != ""))), 1, NEAR_WORDS), " ")
    return rows.withColumn("exact_fp", F.sha1(norm)).withColumn("near_fp", F.sha1(near)).withColumn("norm", norm)


def fold_exact(rows: DataFrame) -> DataFrame:
    """exact_fp, near_fp, norm, pattern_id (the first id), reuse_count."""
    return rows.groupBy("exact_fp").agg(F.first("near_fp").alias("near_fp"), F.first("norm").alias("norm"), F.min("id").alias("pattern_id"), F.count("*").alias("reuse_count"))


def alike(a: str, b: str) -> bool:
    """Whether the matching ratio reaches RATIO; its cheap upper bounds decide most pairs."""
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= RATIO and m.quick_ratio() >= RATIO and reaches(m)


def reaches(m: SequenceMatcher) -> bool:
    """Whether m.ratio() reaches RATIO: the same blocks are matched, but no more once the parts left over are too small."""
    total = len(m.a) + len(m.b)
    matched, possible, parts = 0, min(len(m.a), len(m.b)), [(0, len(m.a), 0, len(m.b))]
    while parts and 2.0 * possible >= RATIO * total - 1e-6:
        a, a_end, b, b_end = parts.pop()
        i, j, n = m.find_longest_match(a, a_end, b, b_end)
        possible -= min(a_end - a, b_end - b)
        if n:
            matched += n
            possible += n + min(i - a, j - b) + min(a_end - i - n, b_end - j - n)
            parts += [p for p in ((a, i, b, j), (i + n, a_end, j + n, b_end)) if p[0] < p[1] and p[2] < p[3]]
    return not parts and (not total or 2.0 * matched / total >= RATIO)


def candidates(patterns: DataFrame) -> DataFrame:
    """pattern_id, reuse_count, and norm and tried, what is to be compared in a row: the text, and of the CANDIDATES best
    patterns of its bucket those earlier ones that can be alike, in their order; both null where there are none.  near_fp,
    place (its place in the bucket) and rest (the text, where a pattern has or is an earlier one beyond those) are for what
    `compared_rest` does.

    Each row has a bounded list, so a bucket of any size is compared in a row each.  The ratio is at most twice the shorter
    text's share of both, so texts of unlike lengths needn't be compared.
    """
    order = Window.partitionBy("near_fp").orderBy(F.desc("reuse_count"), "pattern_id", "exact_fp")
    ranked = patterns.withColumn("place", F.row_number().over(order))
    head = F.when(F.col("place") <= CANDIDATES, F.struct("place", "pattern_id", "norm"))
    heads = ranked.groupBy("near_fp").agg(F.array_sort(F.collect_list(head)).alias("heads"), F.count("*").alias("size"))

    def near(h: Column) -> Column:
        a, b = F.length("norm"), F.length(h["norm"])
        return F.lit(2.0) * F.least(a, b) >= F.lit(RATIO - 1e-9) * (a + b)  # a little less: alike decides at the bound

    tried = F.filter("heads", lambda h: (h["place"] < F.col("place")) & near(h))
    found = ranked.join(heads, "near_fp", "left").withColumn("tried", F.when(F.size(tried) > 0, tried))
    rest = F.when((F.col("size") > CANDIDATES + 1) & (F.col("place") > CANDIDATES), F.col("norm"))
    return found.select("pattern_id", "reuse_count", F.when(F.col("tried").isNotNull(), F.col("norm")).alias("norm"), "tried", "near_fp", "place", rest.alias("rest"))


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of some texts, ascending, and how often each text has each."""
    counts = [np.unique(np.frombuffer(t.encode("utf-32-le"), np.uint32), return_counts=True) for t in texts]
    letters = np.unique(np.concatenate([c[0] for c in counts]))
    table = np.zeros((len(texts), len(letters)), np.int32)
    for row, (own, n) in zip(table, counts):
        row[np.searchsorted(letters, own)] = n
    return letters, table


def first_alike(askers: list[tuple[int, str]], heads: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """(asker, head): for each of the askers (place, text) the first of the heads (place, text) before it that is alike.

    The letters that two texts share bound their ratio as quick_ratio does, here for all askers at once."""
    heads = sorted(heads)
    _, table = _letters([t for _, t in askers] + [t for _, t in heads])
    own, others = table[: len(askers)], table[len(askers) :]
    places, lengths = np.array([p for p, _ in askers]), own.sum(1)
    waiting, out, m = np.arange(len(askers)), [], SequenceMatcher(None)
    for (place, text), has in zip(heads, others):
        later = waiting[places[waiting] > place]
        able = later[2.0 * np.minimum(own[later], has).sum(1) >= (RATIO - 1e-9) * (lengths[later] + len(text))]
        if len(able):
            m.set_seq2(text)  # what the matcher knows of its second text serves all askers
        found = []
        for n in able.tolist():
            m.set_seq1(askers[n][1])
            if reaches(m):
                found.append(n)
                out.append((askers[n][0], place))
        if found:
            waiting = np.setdiff1d(waiting, found, assume_unique=True)
        if not len(waiting):
            break
    return out


def compared_rest(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """(near_fp, place, head): of rows (near_fp, place, linked, rest, chars: its length) those not linked yet, with the first pattern of their
    bucket beyond the CANDIDATES best that is alike and earlier.

    Askers and heads of a bucket meet by their bands of lengths, in cells of some `block` rows of either side, so neither a
    bucket nor a row of its heads is ever held by one task."""
    rows = table.where("chars is not null").withColumn("band", F.floor(F.log(F.greatest("chars", F.lit(1))) / BAND))
    askers = rows.where((F.col("linked") == 0) & (F.col("place") > CANDIDATES + 1)).withColumn("band", F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))))
    blocks = lambda of, name: of.groupBy("near_fp", "band").agg(F.count("*").alias(f"n_{name}"), F.ceil(F.count("*") / block).cast("int").alias(name))
    both = blocks(askers, "a").join(blocks(rows, "h"), ["near_fp", "band"]).withColumn("n", F.col("n_a") + F.col("n_h")).select("near_fp", "band", "n", "a", "h")
    keys = ["near_fp", "band", "i", "j"]
    dealt = lambda of: join_by_share(of.select("near_fp", "band", "place", "rest"), both, ["near_fp", "band"], "n")
    left = dealt(askers).withColumn("i", F.expr("pmod(place, a)")).withColumn("j", F.explode(F.expr("sequence(0, h - 1)"))).select(*keys, "place", "rest")
    right = dealt(rows).withColumn("j", F.expr("pmod(place, h)")).withColumn("i", F.explode(F.expr("sequence(0, a - 1)"))).select(*(F.col(c).alias(c) for c in (*keys, "place", "rest")))  # as columns of their own

    def meet(some: pa.Table, others: pa.Table) -> pa.Table:
        pairs = lambda t: list(zip(t["place"].to_pylist(), t["rest"].to_pylist()))
        found = first_alike(pairs(some), pairs(others)) if some.num_rows and others.num_rows else []
        own = some["near_fp"][0].as_py() if found else None
        return pa.table({"near_fp": pa.array([own] * len(found), pa.string()), "place": pa.array([p for p, _ in found], pa.int32()), "head": pa.array([h for _, h in found], pa.int32())})

    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "near_fp string, place int, head int")
    return met.groupBy("near_fp", "place").agg(F.min("head").alias("head"))


def link_near(patterns: DataFrame, block: int = BLOCK) -> DataFrame:
    """pattern_id, reuse_count, canonical_id: the most reused of the earlier patterns of its bucket that is alike, else itself."""

    @F.arrow_udf("int")
    def first(norms: pa.Array, tried: pa.Array) -> pa.Array:
        out = []
        for low in range(0, len(norms), AT_ONCE):
            for norm, some in zip(*(c.slice(low, AT_ONCE).to_pylist() for c in (norms, tried))):
                out.append(next((h["place"] for h in some or () if alike(norm, h["norm"])), 0))
        return pa.array(out, pa.int32())

    spark, path = patterns.sparkSession, shared_path(patterns.sparkSession, "patterns")
    found = candidates(patterns).withColumn("linked", first("norm", "tried"))
    head_id = F.filter("tried", lambda h: h["place"] == F.col("linked"))[0]["pattern_id"]
    found = found.select("near_fp", "place", "pattern_id", "reuse_count", "linked", F.when(F.col("linked") > 0, head_id).alias("head_id"), "rest", F.length("rest").alias("chars"))
    found.write.parquet(path)  # compared in rows once; the texts of large buckets alone are kept
    table = spark.read.schema(found.schema).parquet(path)
    heads = table.where("chars is not null").select("near_fp", F.col("place").alias("head"), F.col("pattern_id").alias("later_id"))
    later = compared_rest(table, block).join(heads, ["near_fp", "head"]).select("near_fp", "place", "head", "later_id")
    canonical = F.when(F.col("head").isNotNull(), F.col("later_id")).when(F.col("linked") > 0, F.col("head_id")).otherwise(F.col("pattern_id"))
    return table.join(later, ["near_fp", "place"], "left").select("pattern_id", "reuse_count", canonical.alias("canonical_id"))
