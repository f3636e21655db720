"""Document fingerprints by winnowing, in DataFrame functions alone.

A text's grams are its runs of k consecutive words, each hashed.  Of every window of w neighbouring grams the least hash
is chosen, the rightmost of equal ones, with its position.  So two texts that share k + w - 1 consecutive words share a
chosen hash, and each hash tells where in the text it stands.

Hashes are whole longs and positions whole numbers: arrays run backwards inside, so that the first of equal minima is the
rightmost one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text

#: Rows of a task where documents are put in order, and the most tasks; beyond their product tasks grow, and spill.
ROWS_PER_BUCKET = 2000
MOST_BUCKETS = 10_000
_FINE = 100


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often a lambda inside reads it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def fingerprint(text: Column, k: int = 3, window: int = 8) -> Column:
    """The chosen grams of a text: a struct of their positions, ascending, and their hashes; both empty without words.

    A text of fewer than k words is one gram, one of fewer than `window` grams one window.
    """

    def grams(hashes: Column) -> Column:
        full = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (k - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *(hashes[i + j] for j in range(1, k))))
        return F.reverse(F.when(F.size(hashes) >= k, full).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<long>")))

    def chosen(backward: Column) -> Column:
        """Places in the reversed grams: each window's first minimum."""
        windows = F.sequence(F.lit(1), F.greatest(F.size(backward) - (window - 1), F.lit(1)))
        first = F.transform(windows, lambda i: let(F.slice(backward, i, window), lambda s: i + F.array_position(s, F.array_min(s)) - 1))
        return F.when(F.size(backward) > 0, F.reverse(F.array_distinct(first))).otherwise(F.array().cast("array<long>"))

    def told(backward: Column) -> Column:
        size = F.size(backward)
        return let(chosen(backward), lambda at: F.struct(F.transform(at, lambda i: size - i).alias("positions"), F.transform(at, lambda i: backward[i.cast("int") - 1]).alias("hashes")))

    return let(let(F.transform(words(text), lambda w: F.xxhash64(w)), grams), told)


def as_string(chosen: Column) -> Column:
    """position:hash of each chosen gram, comma-joined."""
    return F.array_join(F.zip_with(chosen["positions"], chosen["hashes"], lambda p, h: F.concat_ws(":", p.cast("string"), F.lower(F.hex(h)))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of two fingerprints by all their hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(total > 0, both / total).otherwise(F.lit(1.0))


def with_next(docs: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, text, further columns made of them, and those but the id of the next row as next_*: in descending order of
    ids, after the last comes the first.

    Rows are dealt to buckets by quantiles of the ids, and each bucket also gets a copy of the row that follows its
    last: no task sees more than a bucket.  Rows of one id follow each other by their text's hash; null ids come last.
    """
    spark, more = docs.sparkSession, more or {}
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), "doc_id", "text")
    ids = rows.select("key")
    count, top = ids.agg(F.count("*"), F.max("key")).first()
    if not count:
        none = spark.createDataFrame([], "doc_id long, text string").select("doc_id", "text", *(c.alias(n) for n, c in more.items()))
        return none.select("*", *(F.col(c).alias(f"next_{c}") for c in ("text", *more)))
    buckets = min(MOST_BUCKETS, max(1, math.ceil(count / ROWS_PER_BUCKET)))
    cuts = ids.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)] or [1.0], max(10_000, 10 * buckets))).first()[0]
    cuts = sorted({*cuts, top})  # bucket i has the ids above cuts[i - 1] up to cuts[i]
    every, coarse = F.lit(cuts).cast("array<long>"), F.lit(cuts[_FINE - 1 :: _FINE] or [top]).cast("array<long>")
    level = rows.withColumn("c", F.size(F.filter(coarse, lambda s: s < F.col("key"))) * _FINE)
    level = level.withColumn("bucket", F.col("c") + F.size(F.filter(F.slice(every, F.col("c") + 1, _FINE), lambda s: s < F.col("key"))))
    is_cut = F.array_contains(F.slice(every, F.col("bucket") + 1, 1), F.col("key"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copy"))
    above = F.struct(((F.col("bucket") + 1) % len(cuts)).alias("bucket"), F.when(F.col("key") == F.lit(top), 2).otherwise(1).alias("copy"))
    dealt = level.select("key", "doc_id", "text", F.explode(F.when(is_cut, F.array(own, above)).otherwise(F.array(own))).alias("to"))
    # Dealt before the further columns are made, so that those needn't be moved.
    dealt = dealt.select("key", "doc_id", "text", "to.bucket", "to.copy").repartition("bucket").select("*", *(c.alias(n) for n, c in more.items()))
    order = Window.partitionBy("bucket").orderBy(F.col("copy") == 2, F.col("key").desc(), F.xxhash64("text"))
    kept = ("text", *more)
    return dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in kept)).where("copy = 0").select("doc_id", *kept, *(f"next_{c}" for c in kept))


def fingerprints(docs: DataFrame, k: int = 3, window: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, positions and hashes of its chosen grams.  Null, empty and wordless texts have none; rows are
    independent, other columns are not kept."""
    own = id_and_text(docs, id_col, text_col).select("doc_id", fingerprint(F.col("text"), k, window).alias("chosen"))
    return own.select("doc_id", "chosen.positions", "chosen.hashes")


def edited_likeness(docs: DataFrame, k: int = 3, window: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint against that of an edited text and of the next document.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document.  A null text counts as empty; fingerprints of equal texts are equal; the likeness of two empty ones is 1.
    Repeated rows follow each other, so each is the other's next.  An empty table gives an empty result.
    """
    rows = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = with_next(rows, {"own": fingerprint(F.col("text"), k, window)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    made = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "own", F.col("next_own.hashes").alias("next"))
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "next", fingerprint(F.col("edited"), k, window).alias("other"))
    strings = as_string(F.col("own")).alias("fingerprint"), as_string(F.col("other")).alias("edited_fingerprint")
    return made.select("doc_id", "n_chars", "edited_sha256", *strings, likeness(F.col("own.hashes"), F.col("other.hashes")).alias("near_edited"), likeness(F.col("own.hashes"), F.col("next")).alias("near_next"))
