"""Queries of problem 6: documents packed into containers of 1,024 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.llm.packing import CAPACITY, count_tokens, pack_documents


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{d}/documents.parquet")).filter("piece > 0").select("doc_id").distinct()


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Whether the packing is sound and how full it is: tokens in, tokens packed, containers over capacity, and whether
    the containers number at most 1 % (and one) more than the least possible."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    each = pack_documents(docs).groupBy("container").agg(F.sum("length").alias("used"))
    made = each.agg(F.sum("used").alias("packed"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("used") > CAPACITY).alias("over"))
    tokens = docs.select(count_tokens(F.col("text")).alias("size")).agg(F.sum("size")).scalar()
    made = made.withColumn("tokens", tokens)
    return made.select("tokens", "packed", "over", (F.col("n") <= F.ceil(F.col("tokens") / CAPACITY) * 1.01 + 1).alias("tight"))


_SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_COUNT = rf"len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]+'))"
SQL = {
    "p6_found": f"SELECT doc_id FROM documents WHERE {_COUNT} > 1024",
    "p6_fill": f"SELECT CAST(sum({_COUNT}) AS BIGINT) AS tokens, CAST(sum({_COUNT}) AS BIGINT) AS packed, CAST(0 AS BIGINT) AS over, true AS tight FROM documents",
}
QUERIES = {"p6_found": p6_found, "p6_fill": p6_fill}
