"""All queries of the reference's operators: callables over (spark, sf_dir), and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lorewell.functions.dialect import Duck, Spark
from lorewell.sources.tables import register

from . import conflicts, context, ingest, lessons, memory, recall, relational, retrieval, skills, webfacts

PLANS = relational.PLANS | memory.PLANS


def run_plan(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(PLANS[name](Spark()))


#: Plans in code, with SQL written by hand.
MODULES = (conflicts, context, ingest, lessons, recall, retrieval, skills, webfacts)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: partial(run_plan, name) for name in PLANS}
ORACLE_SQL: dict[str, str] = {name: make(Duck()) for name, make in PLANS.items()}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
