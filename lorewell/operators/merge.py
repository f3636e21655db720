"""Upserts as DataFrame operations: last writer wins on a key, some columns fixed by the first writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by some columns; ties among all of them are broken arbitrarily but once."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str], immutable: list[str] = ()) -> DataFrame:
    """Old and new rows as one table, a row for each key: the latest values, but the first ones of immutable columns.

    One shuffle by key; partial aggregation leaves a row for each key and task, so a much rewritten key is no hot spot.
    Columns that one side lacks are null there."""
    both = old.unionByName(new, allowMissingColumns=True)
    at = F.struct(*order)
    values = [(F.min_by(c, at) if c in immutable else F.max_by(c, at)).alias(c) for c in both.columns if c not in key]
    return both.groupBy(*key).agg(*values).select(*both.columns)


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """New rows, and the old ones of parents that no new row has."""
    gone = new.select(F.col(parent).alias("_parent")).distinct()
    kept = old.join(gone, old[parent].eqNullSafe(gone["_parent"]), "left_anti")
    return kept.unionByName(new)


def append_unique(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old and new rows; raises when executed if a key comes twice."""
    both = old.unionByName(new)
    n = F.count("*").over(Window.partitionBy(*key))
    return both.withColumn("_n", n).where(F.when(F.col("_n") > 1, F.raise_error(F.lit("a key comes twice"))).otherwise(F.lit(True))).drop("_n")
