"""Files as documents, session summaries kept as JSON, and reports written as JSON and Markdown."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DOCUMENT = "document_id string, source_path string, suffix string, content string, content_hash string, error string"
PLAIN, STRUCTURED = (".txt", ".md"), ".json"
#: The folder below a path that holds its packs, each a Parquet table of many files (path, content); hidden from other readers.
PACKS = "_packs"


def _content(suffix: str, data: bytes, indent: bool) -> str:
    """A file's text: plain ones as they are, JSON written anew; other kinds are refused."""
    if suffix in PLAIN:
        return data.decode("utf-8")
    if suffix == STRUCTURED:
        payload = json.loads(data.decode("utf-8"))
        return json.dumps(payload, indent=2, ensure_ascii=False) if indent else str(payload)
    raise ValueError(f"Unsupported file type: {suffix}")


def write_pack(rows: DataFrame, path: str, name: str) -> None:
    """Files (path, content binary) as a pack in a folder: few large files in the store instead of one for each."""
    rows.select("path", "content").write.parquet(f"{path}/{PACKS}/{name}")


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file below a path, and of those in its packs, whose paths are as they were given."""
    loose = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    packs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, PACKS)
    if not packs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(packs):
        return loose
    return loose.unionByName(spark.read.schema("path string, content binary").parquet(f"{path}/{PACKS}/*"))


def load_documents(spark: SparkSession, path: str, indent: bool = True) -> DataFrame:
    """DOCUMENT for every file below a path: a file that can't be read as its kind has an error and no content.

    A document's id comes from its content, so equal files have one id.  `indent` writes JSON over lines, else as Python
    shows it.  Hidden files aren't read, but those in packs are; a file is one row, so it must fit a worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, data in zip(pdf["path"], pdf["content"]):
                name = source.rsplit("/", 1)[-1]
                suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""
                try:
                    text = _content(suffix, bytes(data), indent)
                    digest = hashlib.sha256(text.encode("utf-8")).hexdigest()
                    out.append((f"doc_{digest[:16]}", source, suffix, text, digest, None))
                except ValueError as e:  # decoding errors are among them
                    out.append((None, source, suffix, None, None, str(e).split("\n")[0]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in DOCUMENT.split(", ")])

    return _files(spark, path).mapInPandas(run, DOCUMENT)


def folder_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, text) of the files that folder ingest takes; others, and broken ones, are skipped."""
    return load_documents(spark, path, indent=False).where("error is null").select("source_path", F.col("content").alias("text"))


def load_session_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, chunk_index, summary, place) of files summaries_<session>.json, arrays in any order: by chunk."""
    rows = spark.read.option("multiLine", True).option("pathGlobFilter", "summaries_*.json").option("recursiveFileLookup", True).schema("chunk_index int, summary string, text string").json(path)
    rows = rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^summaries_(.*)\.json$", 1).alias("session_id"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.coalesce("summary", "text", F.lit("")).alias("summary"))
    order = Window.partitionBy("session_id").orderBy("chunk_index", "summary")
    return rows.withColumn("place", F.row_number().over(order).cast("long") - 1)


def write_report(metrics: DataFrame, title: str, path: str) -> None:
    """A table of (metric, value) as rows of JSON in path/json and as a Markdown table in path/markdown."""
    metrics.select("metric", "value").coalesce(1).write.json(f"{path}/json")
    spark = metrics.sparkSession
    head = spark.createDataFrame([(0, "", f"# {title}"), (1, "", ""), (2, "", "| metric | value |"), (3, "", "| --- | --- |")], "n int, metric string, value string")
    body = metrics.select(F.lit(4).alias("n"), "metric", F.concat(F.lit("| "), F.col("metric"), F.lit(" | "), F.col("value").cast("string"), F.lit(" |")).alias("value"))
    head.unionByName(body).repartition(1).sortWithinPartitions("n", "metric").select("value").write.text(f"{path}/markdown")
