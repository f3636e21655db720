"""The input tables, and sources in the formats that ingest accepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")) -> None:
    """Views of the tables; plans bind to the files behind them when they are analysed."""
    for name in names:
        read(spark, sf_dir, name).createOrReplaceTempView(name)


def load_files(spark: SparkSession, path: str, pattern: str = "*.{txt,md,json}") -> DataFrame:
    """Whole text files below a path: document_id (of the content's hash), source_path, kind, text.

    Files of other kinds are left out and unreadable ones skipped, as folder ingest does."""
    rows = spark.read.option("ignoreCorruptFiles", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    rows = rows.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source_path"))
    return rows.select(F.concat(F.lit("doc_"), F.substring(F.sha2("text", 256), 1, 16)).alias("document_id"), "source_path", F.lower(F.regexp_extract("source_path", r"\.([A-Za-z]+)$", 1)).alias("kind"), "text")


def load_session_json(spark: SparkSession, path: str) -> DataFrame:
    """Raw session logs kept as JSON arrays; a message without an index gets its position."""
    rows = spark.read.option("multiLine", True).schema("message_id string, `index` int, sender string, text string, created_at string").json(path)
    rows = rows.withColumn("session_id", F.regexp_extract(F.col("_metadata.file_name"), r"^raw_(.*)\.json$", 1))
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy(F.col("created_at").asc_nulls_first(), "message_id")
    return rows.withColumn("index", F.coalesce("index", F.row_number().over(order) - 1))
