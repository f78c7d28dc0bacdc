"""Queries of problem 3: clean speaker turns, and the clean words of recogniser output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.llm.turns import clean_text, clean_turns, has_word, resolve_speakers, row_texts


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    turns = clean_turns(spark.read.parquet(f"{d}/swda_utterance.parquet"), spark.read.parquet(f"{d}/swda_metadata.parquet"))
    return turns.withColumn("conversation_no", F.col("conversation_no").cast("int"))


def p3_clean_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every row that keeps a word, with its speaker and clean text."""
    utterances = spark.read.parquet(f"{d}/swda_utterance.parquet")
    spoken = resolve_speakers(utterances, spark.read.parquet(f"{d}/swda_metadata.parquet")).filter("word")
    return spoken.join(row_texts(utterances), ["conversation_no", "transcript_index"]).select(F.col("conversation_no").cast("int"), "transcript_index", "speaker", clean_text(F.col("text")).alias("clean_text"))


def p3_asr_words(spark: SparkSession, d: str) -> DataFrame:
    """Per chunk of recogniser output, how many of its words are words once noise is gone."""
    return _asr_entries(spark, d).groupBy("file_id", "chunk_no").agg(F.count(F.lit(1)).alias("n_entries"), F.count_if("spoken").alias("n_spoken"))


def p3_asr_clean_words(spark: SparkSession, d: str) -> DataFrame:
    """The clean words of recogniser output with their place in the chunk (from 0) and times; noise is left out."""
    return _asr_entries(spark, d).filter("spoken").select("file_id", "chunk_no", "word_pos", clean_text(F.col("word")).alias("word"), "start", "end")


def _asr_entries(spark: SparkSession, d: str) -> DataFrame:
    """Each entry of a chunk once, with whether it is a word once noise is gone (spoken)."""
    asr = spark.read.parquet(f"{d}/asr_json.parquet").select("file_id", "chunk_no", "words").dropDuplicates(["file_id", "chunk_no"])
    return asr.select("file_id", "chunk_no", F.posexplode("words").alias("word_pos", "w")).select("file_id", "chunk_no", "word_pos", "w.word", "w.start", "w.end", has_word(F.col("w.word")).alias("spoken"))


_NOTES = r"<<[^<>]*>>|<[^<>]*>|\(\([^()]*\)\)|\([^()]*\)|\[[^\s\[\]+][^\[\]+]*\]|\*[^*]+\*"
_LABEL = r"^\s*(?:(?i:speaker|spk|caller)[\s_\-]*)?[\[@(]?([ABab])[\])]?\s*(?::|>{1,2})"
_STRIPPED = rf"""regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '{_LABEL}', ' '), '{_NOTES}', ' ', 'g'), '[0-9]+:[0-9:.]+', ' ', 'g')"""
_WORDS = rf"""len(list_filter(regexp_extract_all(regexp_replace({_STRIPPED}, '\{{[A-Z] ', ' ', 'g'), '[A-Za-z0-9''-]*[A-Za-z0-9][A-Za-z0-9''-]*'),
  lambda x: NOT regexp_full_match(lower(x), '-*(u+h+|u+h*m+|e+r+m*|e+h+|a+h+m*|h+m+|m{{2,}}|mh+m+)-*'))) > 0"""

ROWS_SQL = rf"""
WITH md AS (
  SELECT DISTINCT conversation_no, unnest([from_caller, to_caller]) AS n, unnest(['A', 'B']) AS side FROM swda_metadata),
r AS (
  SELECT conversation_no, transcript_index, max(utterance_index) AS utterance_index, max(subutterance_index) AS subutterance_index, max(coalesce(text, '')) AS text,
    count(DISTINCT coalesce(text, '')) AS texts, min(coalesce(lab, side, nullif(upper(regexp_extract(coalesce(text, ''), '{_LABEL}', 1)), ''))) AS sure
  FROM (
    SELECT u.*, nullif(upper(regexp_extract(trim(translate(caller, 'ＡＢ', 'AB')), '^(?i:speaker|spk|caller)?[ _-]?[\[@(]?([ABab])[\])]?[.:]?$', 1)), '') AS lab, md.side
    FROM swda_utterance u LEFT JOIN md ON md.conversation_no = u.conversation_no AND md.n = try_cast(u.caller AS INTEGER))
  GROUP BY conversation_no, transcript_index),
b AS (
  SELECT *, coalesce(sure, last_value(sure IGNORE NULLS) OVER w, first_value(sure IGNORE NULLS) OVER v) AS speaker FROM r
  WINDOW w AS (PARTITION BY conversation_no, utterance_index ORDER BY transcript_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         v AS (PARTITION BY conversation_no, utterance_index ORDER BY transcript_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
HAS_WORD_SQL = _WORDS

SQL = {
    "p3_found": ROWS_SQL + rf""",
k AS (SELECT * FROM b WHERE {_WORDS} AND speaker IS NOT NULL),
c AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY conversation_no ORDER BY transcript_index) IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS s FROM k),
t AS (SELECT *, sum(s) OVER (PARTITION BY conversation_no ORDER BY transcript_index ROWS UNBOUNDED PRECEDING) AS turn_no FROM c)
SELECT conversation_no, CAST(turn_no AS INTEGER) AS turn_no, min(speaker) AS speaker, min(transcript_index) AS first_index, max(transcript_index) AS last_index
FROM t GROUP BY conversation_no, turn_no""",
}
QUERIES = {"p3_found": p3_found, "p3_clean_rows": p3_clean_rows, "p3_asr_words": p3_asr_words, "p3_asr_clean_words": p3_asr_clean_words}
