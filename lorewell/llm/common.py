"""Shared helpers of the training-data operators: table access, shared work folders, written tables."""

from __future__ import annotations

import atexit
import gc
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where that is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="lorewell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Names this application's work folder.
_RUN = uuid.uuid4().hex
_ROOTS: dict[str, SparkSession] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which is deleted when the application ends."""
    root = f"{shared_folder(spark)}/lorewell/{_RUN}"
    if root not in _ROOTS and not _ROOTS:
        atexit.register(_remove_all)
    _ROOTS[root] = spark
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _remove_all() -> None:
    for root, spark in _ROOTS.items():
        if spark.sparkContext._jsc is not None:  # else the context is stopped already
            remove(spark, root)


def written(df: DataFrame, name: str, few_files: bool = False) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again, so a lost executor costs no recomputation.

    few_files deals the rows anew into files of the advisory partition size: one for a small table, many for a large one.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    (df.hint("rebalance") if few_files else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for t in tables:
        remove(t.sparkSession, t.work_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def whole_text(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: str = "text") -> Column:
    """128 bits that name a text, a null one as empty."""
    return F.unhex(F.md5(whole_text(column)))


class Kept:
    """What a Python worker keeps between tasks, dropped when no task has asked for it for some seconds: workers serve
    many stages, and tables of one must not stand beside the next one's data."""

    def __init__(self, idle: float = 5.0):
        self.idle, self.found, self.last, self.lock, self.watch = idle, {}, 0.0, threading.Lock(), None

    def get(self, key: Hashable, make: Callable[[], object]) -> object:
        with self.lock:
            self.last = time.monotonic()
            if key not in self.found:
                self.found[key] = make()
                if self.watch is None:
                    self.watch = threading.Thread(target=self._drop, daemon=True)
                    self.watch.start()
            return self.found[key]

    def _drop(self) -> None:
        while True:
            time.sleep(self.idle / 2)
            with self.lock:
                if time.monotonic() - self.last > self.idle:
                    self.found, self.watch = {}, None
                    break
        gc.collect()
        pa.default_memory_pool().release_unused()


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns, whatever their names, can't clash with what an operator adds."""
    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
