"""Queries of problem 7: documents that hold passages of evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from speechloom.llm.leakage import leaks, reparameterised


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"))


def p7_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return reparameterised(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"))


QUERIES = {"p7_found": p7_found, "p7_reparameterised": p7_reparameterised}
SQL: dict[str, str] = {}
