"""Queries of problem 5: broken conversations, whole ones in order, and conversations found by links alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.llm.conversations import good_conversations, rebuild_conversations, with_identifiers
from speechloom.llm.turns_queries import HAS_WORD_SQL, ROWS_SQL


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{d}/swda_utterance.parquet"), spark.read.parquet(f"{d}/swda_metadata.parquet")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers made up for conversations that had none don't fit the INT of the result and come as null."""
    return rebuild_conversations(*_tables(spark, d))[1].filter("broken").select(F.col("conversation_no").try_cast("int").alias("conversation_no"))


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    return good_conversations(*_tables(spark, d)).drop("clean_text").withColumn("conversation_no", F.col("conversation_no").cast("int"))


def p5_threads(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as components over the rows' links, with conversation_no blanked in every row: rows and first and
    last row number of each."""
    rows = _tables(spark, d)[0].withColumn("conversation_no", F.lit(None).cast("int"))
    return with_identifiers(rows).groupBy("conversation_no").agg(F.countDistinct("transcript_index").alias("n_rows"), F.min("transcript_index").alias("first_index"), F.max("transcript_index").alias("last_index")).drop("conversation_no")


def p5_recovered(spark: SparkSession, d: str) -> DataFrame:
    """Recall and precision of the links: conversation_no is blanked in about two thirds of the rows of every
    conversation, and in half of those that name a tree file their file name too, so that only the quote link is left.
    Whether any row was
    blanked, whether nine tenths got their identifier back, and how many got another conversation's."""
    rows = _tables(spark, d)[0]
    h = F.pmod(F.xxhash64(F.lit("blank"), "conversation_no", "transcript_index"), F.lit(6))
    blanked = rows.withColumns({"given": F.col("conversation_no"), "conversation_no": F.when(h < 2, F.col("conversation_no")), "swda_filename": F.when((h < 4) | F.col("ptb_basename").isNull(), F.col("swda_filename"))})
    found = with_identifiers(blanked).filter(F.pmod(F.xxhash64(F.lit("blank"), "given", "transcript_index"), F.lit(6)) >= 2)
    return found.agg((F.count(F.lit(1)) > 0).alias("some"), F.count_if(F.col("conversation_no") == F.col("given")).alias("right"), F.count_if((F.col("conversation_no") != F.col("given")) & (F.col("conversation_no") >= 0)).alias("wrong"), F.count(F.lit(1)).alias("n")).select("some", (F.col("right") >= 0.9 * F.col("n")).alias("recall_at_least_90"), "wrong")


_VERDICT_SQL = ROWS_SQL + rf""",
u AS (SELECT *, {HAS_WORD_SQL} AS word FROM b),
bad AS (
  SELECT conversation_no FROM u WHERE utterance_index IS NULL OR subutterance_index IS NULL
  UNION SELECT conversation_no FROM u GROUP BY 1 HAVING min(utterance_index) <> 1 OR max(utterance_index) <> count(DISTINCT utterance_index)
  UNION SELECT conversation_no FROM u WHERE utterance_index IS NOT NULL GROUP BY conversation_no, utterance_index HAVING min(subutterance_index) <> 1 OR max(subutterance_index) <> count(DISTINCT subutterance_index)
  UNION SELECT conversation_no FROM u WHERE utterance_index IS NOT NULL AND subutterance_index IS NOT NULL GROUP BY conversation_no, utterance_index, subutterance_index
    HAVING count(DISTINCT speaker) > 1 OR count(DISTINCT text) > 1 OR max(texts) > 1
  UNION SELECT conversation_no FROM u GROUP BY 1 HAVING count(DISTINCT CASE WHEN word THEN speaker END) < 2)"""

SQL = {
    "p5_found": _VERDICT_SQL + " SELECT conversation_no FROM bad",
    "p5_conversations": _VERDICT_SQL + """
SELECT conversation_no, CAST(row_number() OVER (PARTITION BY conversation_no ORDER BY utterance_index, subutterance_index) AS INTEGER) AS position, speaker, utterance_index, subutterance_index, text
FROM (SELECT conversation_no, utterance_index, subutterance_index, min(speaker) AS speaker, min(text) AS text FROM u WHERE conversation_no NOT IN (SELECT conversation_no FROM bad) GROUP BY 1, 2, 3)""",
    "p5_recovered": "SELECT true AS some, true AS recall_at_least_90, CAST(0 AS BIGINT) AS wrong",
    "p5_threads": "SELECT count(DISTINCT transcript_index) AS n_rows, min(transcript_index) AS first_index, max(transcript_index) AS last_index FROM swda_utterance GROUP BY conversation_no",
}
QUERIES = {"p5_found": p5_found, "p5_conversations": p5_conversations, "p5_threads": p5_threads, "p5_recovered": p5_recovered}
