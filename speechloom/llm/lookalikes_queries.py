"""Queries of problem 4: words and transcripts that look like their plain form but are written otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.llm.lookalikes import differs_from_plain, is_ascii, is_lexicon_alike, unify


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    lexicon, asr = spark.read.parquet(f"{d}/lexicon.parquet"), spark.read.parquet(f"{d}/asr_json.parquet")
    words = asr.select("file_id", "chunk_no", F.posexplode(F.transform("words", lambda w: w["word"])).alias("word_pos", "word"))
    by_word = is_lexicon_alike(words, "word", lexicon).select("file_id", "chunk_no", F.lit("word").alias("field"), "word_pos", "lex_id")
    odd = differs_from_plain(lexicon)
    texts = asr.select("file_id", "chunk_no", "transcript").filter(F.col("transcript").isNotNull() & (~is_ascii(F.col("transcript")) | F.col("transcript").rlike(r"[\t-\r\x1c-\x1f]")))
    by_text = texts.filter(odd(F.col("transcript"))).select("file_id", "chunk_no", F.lit("transcript").alias("field"), F.lit(-1).alias("word_pos"), F.lit(-1).alias("lex_id"))
    return by_word.unionByName(by_text).distinct()


def p4_plain_words(spark: SparkSession, d: str) -> DataFrame:
    """How often each word occurs once all words are in their consistent form."""
    asr = spark.read.parquet(f"{d}/asr_json.parquet").select(F.explode(F.transform("words", lambda w: w["word"])).alias("word"))
    counts = asr.filter("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    plain = unify(counts, "word", spark.read.parquet(f"{d}/lexicon.parquet"))
    return plain.groupBy(F.trim("word").alias("word")).agg(F.sum("n").alias("n"))


def p4_plain_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """The transcript of every row in its plain form; null transcripts stay null."""
    asr = spark.read.parquet(f"{d}/asr_json.parquet").select("file_id", "chunk_no", "transcript")
    return unify(asr, "transcript", spark.read.parquet(f"{d}/lexicon.parquet"))


QUERIES = {"p4_found": p4_found, "p4_plain_words": p4_plain_words, "p4_plain_transcripts": p4_plain_transcripts}
SQL: dict[str, str] = {}
