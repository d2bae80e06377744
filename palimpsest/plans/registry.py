"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans import core_queries, orphan_queries

QUERIES = {**orphan_queries.QUERIES, **core_queries.QUERIES}
ORACLE = {**orphan_queries.ORACLE, **core_queries.ORACLE}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core_queries.QUERIES["hybrid_search"](spark, sf_dir)
