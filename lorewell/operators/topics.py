"""Topics of documents and the graph of both: words counted over all documents, a model fitted on some, every one placed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the fit: words of the vocabulary, and documents that the model is fitted on (about; at most twice as many).
VOCABULARY, SAMPLE = 20_000, 20_000
SEED, ITERATIONS = 7, 30
#: Offset of the learning rate: small, as a fit has few passes over whole samples.
OFFSET = 10.0
#: Documents none of whose topics has this share are outliers, topic -1.
LEAST_SHARE = 0.3
CONTENT_CHARS = 100


@dataclass(frozen=True)
class Topics:
    """vocabulary and model of a fit, and each topic's label, its likeliest word; no words, no model."""

    vocabulary: list[str]
    model: LDAModel | None
    labels: list[str]


def bag(text: str) -> Column:
    """A text's words of two letters or digits or more, lower-cased, repeats kept; none for a null."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)


def _counted(bags: DataFrame, vocabulary: list[str]) -> DataFrame:
    return CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="counts").transform(bags)


def fit_topics(docs: DataFrame, k: int, least_docs: int = 2, most_share: float = 0.5, vocabulary: int = VOCABULARY, sample: int = SAMPLE) -> Topics:
    """k topics of documents (doc_id, text).

    The vocabulary: the words in the most documents, those in fewer than `least_docs` or in over `most_share` of all
    apart, ties by the word.  Counts cover all documents; the model is fitted on those with the smallest hashes.
    """
    bags = docs.select("doc_id", bag("text").alias("words"))
    n = bags.count()
    counts = bags.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    counts = counts.where(F.col("docs").between(least_docs, max(least_docs, int(most_share * n))))
    kept = [r.word for r in counts.orderBy(F.col("docs").desc(), "word").limit(vocabulary).collect()]
    if not kept:
        return Topics([], None, [])
    some = bags.where(F.pmod(F.xxhash64("doc_id", "words"), F.lit(max(n, 1))) < sample)
    # Repeated rows share a hash, so that the share alone bounds nothing.
    some = _counted(some, kept).select("counts").limit(2 * sample).repartition(docs.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        model = LDA(k=k, maxIter=ITERATIONS, seed=SEED, optimizer="online", subsamplingRate=1.0, learningOffset=OFFSET, featuresCol="counts").fit(some)
    finally:
        some.unpersist()
    labels = {r.topic: kept[r.termIndices[0]] for r in model.describeTopics(1).collect()}
    return Topics(kept, model, [labels[i] for i in range(k)])


def place_documents(docs: DataFrame, topics: Topics, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, topic, weight) of every document: its likeliest topic and that topic's share.

    Topic -1 and weight 0 for one without words of the vocabulary, topic -1 for one without a topic of `least_share`.
    A row for each row; of equal shares the first topic's.
    """
    bags = docs.select("doc_id", bag("text").alias("words"))
    if topics.model is None:
        return bags.select("doc_id", F.lit(-1).alias("topic"), F.lit(0.0).alias("weight"))
    topics.model.setTopicDistributionCol("shares")
    rows = topics.model.transform(_counted(bags, topics.vocabulary)).select("doc_id", vector_to_array("shares").alias("shares"))
    weight = F.array_max("shares")
    topic = F.when(weight >= least_share, F.array_position("shares", weight).cast("int") - 1).otherwise(-1)
    return rows.select("doc_id", topic.alias("topic"), weight.alias("weight"))


def topic_graph(docs: DataFrame, placed: DataFrame, topics: Topics) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, node_type, label) and edges (doc_node, topic_node, weight) of documents and their topics.

    A document's label is the beginning of its text.  A topic that no document has is no node, an outlier has no edge.
    """
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    topic = F.concat(F.lit("topic_"), F.col("topic").cast("string"))
    edges = placed.where("topic >= 0").select(name.alias("doc_node"), topic.alias("topic_node"), "weight")
    documents = docs.select(name.alias("node_id"), F.lit("document").alias("node_type"), F.substring(F.coalesce("text", F.lit("")), 1, CONTENT_CHARS).alias("label"))
    labels = F.element_at(F.array(*map(F.lit, topics.labels or [""])), F.col("topic") + 1)
    themes = placed.where("topic >= 0").select("topic").distinct().select(topic.alias("node_id"), F.lit("topic").alias("node_type"), labels.alias("label"))
    return documents.unionByName(themes), edges
