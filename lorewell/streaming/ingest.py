"""Append-only message logs as streams: upserts, mirrored turns, rolling tails.

Each stream runs until what is there now is read (availableNow) and leaves a table in the shared folder; started again on
the same checkpoint it takes up what has come since.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.operators.merge import keep_latest

TAIL = 3


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder, in a temporary one where none is set in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{base or 'file://' + tempfile.gettempdir()}/lorewell-stream/{name}-{uuid.uuid4().hex}"


def message_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files below a path as a stream of messages; the schema is read from the files there are."""
    rows = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4)
    folder, _, name = path.rstrip("/").rpartition("/")
    source = rows.option("pathGlobFilter", name).parquet(folder) if path.endswith(".parquet") and not _is_folder(spark, path) else rows.parquet(path)
    return source.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), F.col("role").alias("sender"), "text")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _run(stream: DataFrame, name: str, out: str, write=None) -> None:
    spark = stream.sparkSession
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", shared_path(spark, f"{name}-state"))
    query = (writer.foreachBatch(write) if write else writer.format("parquet").option("path", out).outputMode("append")).start()
    query.awaitTermination()


def upserted_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages as they stand after the stream: a message delivered twice or changed later counts in its last form.

    A batch is cut to its latest row of each key and appended with its number, so writing a batch again (after a failure)
    overwrites the same part; reading keeps the latest batch's row."""
    out = shared_path(spark, "messages")

    def write(batch: DataFrame, number: int) -> None:
        latest = keep_latest(batch.withColumn("_h", F.xxhash64(*batch.columns)), ["session_id", "message_id"], ["_h"]).drop("_h")
        latest.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/number={number}")

    stream = message_stream(spark, path)
    _run(stream, "messages", out, write)
    return keep_latest(spark.read.parquet(out).drop("number"), ["session_id", "message_id"], ["batch"]).drop("batch")


def mirrored_turns(spark: SparkSession, path: str) -> DataFrame:
    """Each turn as a message, its text part and a context item: one stateless pass."""
    kinds = F.explode(F.array(F.struct(F.lit("message").alias("kind"), F.col("text").alias("text")), F.struct(F.lit("part").alias("kind"), F.col("text").alias("text")), F.struct(F.lit("context_item").alias("kind"), F.substring("text", 1, 200).alias("text"))))
    stream = message_stream(spark, path).select("session_id", "message_id", kinds.alias("x")).select("session_id", "message_id", "x.kind", "x.text")
    out = shared_path(spark, "turns")
    _run(stream, "turns", out)
    return spark.read.schema(stream.schema).parquet(out)


def rolling_tails(spark: SparkSession, path: str, size: int = TAIL) -> DataFrame:
    """The last messages of each session, kept as the stream's state: session_id, tail (ids, comma-joined).

    The state is `size` ids for each session; a batch's rows of a session stream through it."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids = list(state.get[0]) if state.exists else []
        for pdf in frames:
            ids = sorted({*ids, *pdf["message_id"].tolist()})[-size:]
        state.update((ids,))
        yield pd.DataFrame({"session_id": [key[0]], "tail": [",".join(map(str, ids))], "n": [len(ids)], "last": [ids[-1]]})

    stream = message_stream(spark, path).select("session_id", "message_id")
    tails = stream.groupBy("session_id").applyInPandasWithState(fold, "session_id long, tail string, n long, last long", "ids array<long>", "update", GroupStateTimeout.NoTimeout)
    out = shared_path(spark, "tails")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/number={number}")

    query = tails.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", shared_path(spark, "tails-state")).foreachBatch(write).start()
    query.awaitTermination()
    return keep_latest(spark.read.parquet(out).drop("number"), ["session_id"], ["batch", "last", "n"]).select("session_id", "tail")
