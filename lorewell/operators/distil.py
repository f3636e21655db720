"""Skill memory: notes distilled into typed artifacts, and what each type of artifact says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cues of each class in order (the first that fits wins), the artifacts' namespaces, lengths and confidence.
CUES = {
    "rubric": ("rubric", "score", "criteria", "1-5"),
    "template": ("template", "[hook]"),
    "example": ("before:", "after:", "good:", "bad:", "example"),
    "anti_pattern": ("anti-pattern", "mistake", "avoid", "don't"),
    "workflow": ("->", "→", "step ", "then ", "workflow"),
    "style_gist": ("tone", "voice", "style"),
    "principle": ("principle", "rule", "should", "always", "never"),
}
NAMESPACES = {
    "raw_chunk": "craft_raw",
    "principle": "craft_principles",
    "template": "craft_templates",
    "example": "craft_examples",
    "rubric": "craft_rubrics",
    "anti_pattern": "craft_antipatterns",
    "workflow": "craft_workflows",
    "style_gist": "style_profiles",
}
CONTENT_NAMESPACE = "content_books_raw"
RAW_CHARS, SENTENCE_CHARS = 6000, 2000
RAW_CONFIDENCE, SENTENCE_CONFIDENCE = 1.0, 0.75


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def one_line(x: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def sentences(text: Column) -> Column:
    """A text's sentences: cut at line ends, and at white space after a full stop, an exclamation or a question mark."""
    return F.filter(F.transform(F.split(text, r"\n+|(?<=[.!?])\s+"), stripped), lambda s: s != "")


def sentence_class(s: Column, cues: dict[str, tuple[str, ...]] = CUES) -> Column:
    """The first class one of whose cues occurs, whatever its case; null if none does.  Two braces make a template."""
    out = F.lit(None).cast("string")
    for kind, words in reversed(cues.items()):
        fits = reduce(lambda a, b: a | b, (F.contains(F.lower(s), F.lit(w)) for w in words))
        if kind == "template":
            fits = fits | (F.contains(s, F.lit("{")) & F.contains(s, F.lit("}")))
        out = F.when(fits, F.lit(kind)).otherwise(out)
    return out


def distilled(chunks: DataFrame, cues: dict[str, tuple[str, ...]] = CUES) -> DataFrame:
    """Artifacts of chunks (ref, source_kind, text): ref, artifact_type, namespace, artifact_id, text, normalized_key,
    confidence.

    Each chunk with a text is an artifact itself; those of the kind `craft` give one more for each sentence with a class.
    Null and blank texts give none, repeated sentences one each time; equal artifacts have equal ids.
    """
    body = chunks.select("ref", F.coalesce(F.lower("source_kind") == "content", F.lit(False)).alias("content"), stripped(F.col("text")).alias("body")).where("body <> ''")

    def artifact(kind: Column, text: Column, confidence: float) -> Column:
        return F.struct(kind.alias("artifact_type"), text.alias("text"), F.lit(confidence).alias("confidence"))

    raw = F.array(artifact(F.lit("raw_chunk"), stripped(F.substring("body", 1, RAW_CHARS)), RAW_CONFIDENCE))
    made = F.transform(sentences(F.col("body")), lambda s: artifact(sentence_class(s, cues), stripped(F.substring(s, 1, SENTENCE_CHARS)), SENTENCE_CONFIDENCE))
    rows = body.select("ref", "content", F.explode(F.when(F.col("content"), raw).otherwise(F.concat(raw, F.filter(made, lambda a: a["artifact_type"].isNotNull())))).alias("a"))
    places = F.create_map(*(F.lit(x) for pair in NAMESPACES.items() for x in pair))
    space = F.when(F.col("content"), CONTENT_NAMESPACE).otherwise(F.element_at(places, F.col("a.artifact_type")))
    rows = rows.select("ref", "a.artifact_type", space.alias("namespace"), "a.text", one_line(F.col("a.text")).alias("normalized_key"), "a.confidence")
    digest = F.substring(F.sha1(F.concat_ws("|", "artifact_type", "namespace", "normalized_key")), 1, 16)
    return rows.withColumn("artifact_id", F.concat_ws(":", F.lit("skill"), "artifact_type", digest))


def _parts(x: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(x, separator), stripped), lambda p: p != "")


def detailed(artifacts: DataFrame) -> DataFrame:
    """Artifacts with what their type says, null for other types: slots, criteria, scale, verdict, steps, traits."""
    text, key = F.col("text"), F.col("normalized_key")
    of = lambda kind, value: F.when(F.col("artifact_type") == kind, value)
    words = F.split(F.replace(text, F.lit("{"), F.lit(" {")), r"\s+")
    braced = F.filter(words, lambda w: F.startswith(w, F.lit("{")) & F.endswith(w, F.lit("}")))
    slots = F.array_sort(F.array_distinct(F.transform(braced, lambda w: F.lower(stripped(F.substring(w, F.lit(2), F.length(w) - 2))))))
    steps = F.filter(F.transform(F.split(F.replace(text, F.lit("→"), F.lit("->")), "->"), lambda p: F.regexp_replace(p, r"^[ -]+|[ -]+$", "")), lambda p: p != "")
    good = F.contains(key, F.lit("good")) | F.contains(key, F.lit("after"))
    return artifacts.select(
        "*",
        of("template", slots).alias("slots"),
        of("rubric", _parts(text, ";")).alias("criteria"),
        of("rubric", F.when(F.contains(text, F.lit("1-5")), "1-5").otherwise("unspecified")).alias("scale"),
        of("example", F.when(good, "good").otherwise("neutral")).alias("verdict"),
        of("workflow", steps).alias("steps"),
        of("style_gist", _parts(text, ",")).alias("traits"),
    )
