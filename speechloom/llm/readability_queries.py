"""Queries of problem 8: demanding documents, and the reading-level profile of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.llm.readability import demanding, reading_levels


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return demanding(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/doc_levels.parquet"))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each rounded level, by language."""
    levels = reading_levels(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/doc_levels.parquet"))
    return levels.groupBy("ja", F.least(F.greatest(F.round("level"), F.lit(1.0)), F.lit(5.0)).cast("int").alias("rounded_level")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p8_found": p8_found, "p8_profile": p8_profile}
SQL: dict[str, str] = {}
