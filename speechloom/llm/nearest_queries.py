"""Queries of problem 2: the word nearest to each candidate's start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.llm.nearest import nearest_in_time, word_points
from speechloom.operators.periods import to_units


def _matches(spark: SparkSession, d: str) -> DataFrame:
    left = spark.read.parquet(f"{d}/candidates.parquet").select("file_id", "gap_index", "island_index", to_units(F.col("candidate_start")).alias("t"))
    return nearest_in_time(left, word_points(spark.read.parquet(f"{d}/asr_json.parquet")), "file_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select(
        "file_id", "gap_index", "island_index", F.shiftright("ref", 31).cast("int").alias("chunk_no"), F.col("ref").bitwiseAND((1 << 31) - 1).cast("int").alias("word_pos")
    )


_SQL = r"""
WITH w AS (
  SELECT DISTINCT file_id, chunk_no, pos - 1 AS word_pos, CAST(round(words[pos].start * 10000) AS BIGINT) AS s, CAST(round(words[pos]."end" * 10000) AS BIGINT) AS e
  FROM (SELECT file_id, chunk_no, words, unnest(range(1, len(words) + 1)) AS pos FROM asr_json)
  WHERE regexp_matches(words[pos].word, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')
    AND NOT isnan(words[pos].start) AND NOT isnan(words[pos]."end") AND words[pos]."end" > words[pos].start),
c AS (
  SELECT DISTINCT file_id, gap_index, island_index, CAST(round(candidate_start * 10000) AS BIGINT) AS t FROM candidates
  WHERE candidate_start IS NOT NULL AND NOT isnan(candidate_start)),
p AS (
  SELECT file_id, gap_index, island_index, chunk_no, word_pos, least(abs(t - s), abs(t - e)) AS d
  FROM (SELECT *, unnest([t // 30000 - 1, t // 30000, t // 30000 + 1]) AS k FROM c)
  JOIN (SELECT *, unnest(CASE WHEN s // 30000 = e // 30000 THEN [s // 30000] ELSE [s // 30000, e // 30000] END) AS k FROM w) USING (file_id, k)
  WHERE least(abs(t - s), abs(t - e)) <= 1500)
SELECT file_id, gap_index, island_index, chunk_no, CAST(word_pos AS INTEGER) AS word_pos FROM p
QUALIFY row_number() OVER (PARTITION BY file_id, gap_index, island_index ORDER BY d, chunk_no, word_pos) = 1"""

QUERIES = {"p2_found": p2_found}
SQL = {"p2_found": _SQL}
