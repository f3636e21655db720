"""The corpus pipeline: documents in, token ids out.

STAGES lists (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import langid, secrets
from lorewell.llm.bpe import bpe_encode
from lorewell.llm.common import table, text_key, work_path
from lorewell.llm.decontam import find_leaks
from lorewell.llm.near_dedup import near_duplicates

#: Least score of a language: a little above what an even split between four languages has.  Short clean texts pass.
LEAST_SCORE = 0.3


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that aren't among some rows (doc_id, text_key): another text of the same id, or of a null one, stays."""
    gone = rows.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return docs.join(gone, F.col("doc_id").eqNullSafe(gone["gone_id"]) & (text_key() == gone["gone_key"]), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts, texts without a letter, and those that no language fits."""
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.accepted(docs, model, LEAST_SCORE) if model.labels else docs.where(F.col("text").rlike(r"\p{L}"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates, and repeated rows once."""
    found = near_duplicates(docs, k=5, threshold=0.8, with_key=True)
    kept = _without(docs, found.where("not kept"))
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return _without(docs, find_leaks(docs, table(spark, sf_dir, "benchmark"), with_key=True))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and replaces the secrets in it."""
    return secrets.without_secrets(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, ids, exact (whether they decode to the text)."""
    import public_tokenizers as tok

    return bpe_encode(docs, tok.path("byte_bpe_multi_50k.tiktoken"), tok.PATTERN, output="ids")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the network nor the transducer; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
