"""Queries of problem 1: periods and holes of the candidate and gap spans of each recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.operators.periods import periods_and_holes, unpivot_spans

SPANS = {"candidate": ("candidate_start", "candidate_end"), "gap": ("gap_start", "gap_end")}
MAX_HOLE = 12_000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = unpivot_spans(spark.read.parquet(f"{d}/candidates.parquet"), ["file_id"], SPANS)
    out = periods_and_holes(rows, ["file_id", "field"], MAX_HOLE)
    return out.filter("kind = 'hole' or several").select("file_id", "field", "kind", F.col("begin").alias("begin_e4"), F.col("finish").alias("finish_e4"))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per recording and field: number of periods and holes, units covered and uncovered."""
    rows = unpivot_spans(spark.read.parquet(f"{d}/candidates.parquet"), ["file_id"], SPANS)
    length = F.col("finish") - F.col("begin")
    return periods_and_holes(rows, ["file_id", "field"]).groupBy("file_id", "field").agg(
        F.count_if(F.col("kind") == "period").alias("n_periods"), F.count_if(F.col("kind") == "hole").alias("n_holes"),
        F.sum(F.when(F.col("kind") == "period", length).otherwise(0)).alias("covered_e4"), F.sum(F.when(F.col("kind") == "hole", length).otherwise(0)).alias("uncovered_e4"),
    )


_PERIODS_SQL = """
WITH spans AS (
  SELECT DISTINCT file_id, field, CAST(round(s * 10000) AS BIGINT) AS b, CAST(round(e * 10000) AS BIGINT) AS e FROM (
    SELECT file_id, 'candidate' AS field, candidate_start AS s, candidate_end AS e FROM candidates
    UNION ALL SELECT file_id, 'gap', gap_start, gap_end FROM candidates)
  WHERE s IS NOT NULL AND e IS NOT NULL AND NOT isnan(s) AND NOT isnan(e) AND e > s),
marked AS (
  SELECT *, max(e) OVER (PARTITION BY file_id, field ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM spans),
grouped AS (
  SELECT *, sum(CASE WHEN m IS NULL OR b > m THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, field ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS g FROM marked),
periods AS (SELECT file_id, field, g, min(b) AS b, max(e) AS e, count(*) AS n FROM grouped GROUP BY file_id, field, g),
holes AS (
  SELECT file_id, field, e AS b, lead(b) OVER (PARTITION BY file_id, field ORDER BY b) AS e FROM periods)
"""

SQL = {
    "p1_found": _PERIODS_SQL + """
SELECT file_id, field, 'period' AS kind, b AS begin_e4, e AS finish_e4 FROM periods WHERE n >= 2
UNION ALL SELECT file_id, field, 'hole', b, e FROM holes WHERE e IS NOT NULL AND e - b <= 12000""",
    "p1_coverage": _PERIODS_SQL + """
SELECT file_id, field, count(*) AS n_periods, count(*) - 1 AS n_holes, CAST(sum(e - b) AS BIGINT) AS covered_e4,
       CAST(max(e) - min(b) - sum(e - b) AS BIGINT) AS uncovered_e4 FROM periods GROUP BY file_id, field""",
}
QUERIES = {"p1_found": p1_found, "p1_coverage": p1_coverage}
