"""Joins with one small row for each key, where some keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that are broadcast, and the least rows of one.
FREQUENT_MOST, FREQUENT_LEAST = 100_000, 1_000


def frequent_from(info: DataFrame, n: str, most: int = FREQUENT_MOST, least: int = FREQUENT_LEAST) -> int:
    """The number of rows from which on a key counts as frequent: at most `most` keys can have so many."""
    total = info.agg(F.sum(n)).first()[0] or 0
    return max(least, -(-total // most))


def join_by_share(rows: DataFrame, info: DataFrame, keys: list[str], n: str, how: str = "inner", least: int = FREQUENT_LEAST) -> DataFrame:
    """rows joined with info (unique in keys; n: how many rows have the key).

    Frequent keys, whose number is bounded by their share, go out by broadcast, so their rows stay where they are; the
    rest is shuffled, and none of its keys has many rows."""
    bound = frequent_from(info, n, least=least)
    near = F.broadcast(info.where(F.col(n) >= bound))
    rest = rows.join(near.select(*keys), keys, "left_anti").join(info.where(F.col(n) < bound), keys, how)
    return rows.join(near, keys).unionByName(rest)
