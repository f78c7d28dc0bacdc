"""Queries over files: each writes a whole table in a format to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom import schema as S
from speechloom.functions import text as T
from speechloom.operators import corpus as C
from speechloom.operators import measures as M
from speechloom.plans import interval_queries as IQ
from speechloom.plans.interval_queries import _MEASURES, _STATS, WORDS, _located
from speechloom.plans.sequence_sql import _MARKUP, _WS, _normal
from speechloom.session import shared_path, written
from speechloom.sinks import writers as W
from speechloom.sources import files as R
from speechloom.sources import textgrid as TG


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chunk_id() -> Column:
    return F.concat_ws("_", "file_id", "chunk_no")


def _asr(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "asr_json").dropDuplicates(["file_id", "chunk_no"])


def asr_json_files(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as JSON files, one each, and the usable words read from them in order."""
    path = shared_path(spark, "asr")
    W.write_per_file(_asr(spark, d).select(_chunk_id().alias("file_id"), F.to_json(F.struct("duration", "transcript", "n_words", "words", "filler_augmentation")).alias("value")), path)
    return R.asr_words(R.read_asr_json(spark, path))


def aligner_json_files(spark: SparkSession, d: str) -> DataFrame:
    """Words as an aligner's JSON files and read back; entries are [start, end, word]."""
    path = shared_path(spark, "aligner")
    entries = F.transform("words", lambda w: F.array(w["start"].cast("string"), w["end"].cast("string"), w["word"]))
    W.write_per_file(_asr(spark, d).select(_chunk_id().alias("file_id"), F.to_json(F.struct(F.struct(F.struct(entries.alias("entries")).alias("words")).alias("tiers"))).alias("value")), path)
    return R.read_aligner_json(spark, path)


def file_lists(spark: SparkSession, d: str) -> DataFrame:
    """File ids as a JSON list and as a list under a key, read from both."""
    ids = _t(spark, d, "intervals").agg(F.sort_array(F.collect_set("file_id")).alias("ids"))
    bare, keyed = shared_path(spark, "list"), shared_path(spark, "list")
    ids.select(F.to_json("ids").alias("value")).write.text(bare)
    ids.select(F.to_json(F.struct(F.col("ids").alias("all_selected"))).alias("value")).write.text(keyed)
    return R.read_file_list(spark, bare).withColumn("form", F.lit("bare")).unionByName(R.read_file_list(spark, keyed).withColumn("form", F.lit("keyed")))


def candidate_csv(spark: SparkSession, d: str) -> DataFrame:
    """Candidates as one CSV per recording, read back with their types."""
    path = shared_path(spark, "candidates")
    c = _t(spark, d, "candidates").select(*S.CANDIDATES.fieldNames()).distinct()
    W.write_csv_per_file(c, path)
    empty = shared_path(spark, "candidates")
    W.write_csv(W.empty_candidates(spark), empty)
    return R.read_candidates(spark, path).unionByName(R.read_candidates(spark, empty)).select(*S.CANDIDATES.fieldNames())


def measures_csv(spark: SparkSession, d: str) -> DataFrame:
    """Fluency measures as a CSV and read back."""
    m = IQ.fluency_measures(spark, d)
    path = shared_path(spark, "measures")
    W.write_csv(m.select(F.col("file_id").alias("file"), *M.MEASURES, F.col("units").alias("total_syllables"), "total_duration", "phonation_time", "n_pauses", F.col("n_mid_clause_pauses"), "n_end_clause_pauses", "n_clauses", F.lit(None).cast("string").alias("error")), path)
    return R.read_measures(spark, path).drop("error")


def rounded_measures(spark: SparkSession, d: str) -> DataFrame:
    """Measures rounded to three places, ties to even, as reports give them, with the mean pause as a label."""
    from speechloom.operators.agreement import round_half_even

    m = IQ.fluency_measures(spark, d)
    return m.select("file_id", *[round_half_even(F.col(c), F.lit(3)).alias(c) for c in M.MEASURES], T.metric_label(F.when(F.col("n_pauses") > 0, F.col("MPD"))).alias("mpd_label"))


def gold_segment_files(spark: SparkSession, d: str) -> DataFrame:
    """Clauses as text files, one line each after a byte-order mark, read back as numbered segments."""
    path = shared_path(spark, "gold")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"])
    text = F.concat(F.lit("﻿"), F.array_join(lines, "\r\n"))
    W.write_per_file(M.clause_rows(_t(spark, d, "intervals")).groupBy("file_id").agg(text.alias("value")), path)
    return R.read_gold_segments(spark, [path])


def transcript_files(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts as text files, one per chunk, read back normalised."""
    path = shared_path(spark, "transcripts")
    W.write_per_file(_asr(spark, d).filter("transcript is not null").select(_chunk_id().alias("file_id"), F.col("transcript").alias("value")), path)
    return R.read_transcripts(spark, path)


def parallel_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Labelled sentences as parallel files of words and labels, joined again by line number."""
    path = shared_path(spark, "pair")
    s = C.labelled_sentences(C.utterance_texts(_t(spark, d, "swda_utterance")))
    W.write_label_pair(s, ["conversation_no", "utterance_index", "caller"], path)
    both = R.parallel_lines(spark, {"words": f"{path}.dis", "labels": f"{path}.labels"})
    return both.select(F.col("line_no").cast("int").alias("line_no"), "words", "labels")


def _swda(spark: SparkSession, d: str) -> DataFrame:
    many = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|||")
    return _t(spark, d, "swda_utterance").select(*S.SWDA_COLUMNS).distinct().withColumns({"trees": many("trees"), "ptb_treenumbers": many("ptb_treenumbers")})


def _flat(u: DataFrame) -> DataFrame:
    return u.select("conversation_no", "transcript_index", "act_tag", "caller", "utterance_index", "subutterance_index", F.coalesce("text", F.lit("")).alias("text"), F.size("trees").alias("n_trees"), F.array_join(F.transform("ptb_treenumbers", lambda x: x.cast("string")), ",").alias("numbers"))


def swda_by_header(spark: SparkSession, d: str) -> DataFrame:
    """Utterances as CSV with a header, read back typed."""
    path = shared_path(spark, "swda")
    _swda(spark, d).write.option("header", True).option("escape", "\"").option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return _flat(R.read_swda(spark, path)).distinct()


def swda_by_position(spark: SparkSession, d: str) -> DataFrame:
    """Utterances as CSV read by position: caller, utterance index and text."""
    path = shared_path(spark, "swda")
    _swda(spark, d).write.option("header", True).option("escape", "\"").option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return R.read_swda_positional(spark, path).distinct()


def metadata_csv(spark: SparkSession, d: str) -> DataFrame:
    """Conversation metadata as CSV with six-digit days, read back typed."""
    path = shared_path(spark, "metadata")
    names = S.SWDA_METADATA_RAW.fieldNames()
    m = _t(spark, d, "swda_metadata").select(*names).distinct().withColumn("talk_day", F.date_format("talk_day", "yyMMdd"))
    m.write.option("header", True).option("escape", "\"").option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return R.read_swda_metadata(spark, path).select("conversation_no", F.date_format("talk_day", "MMdd").alias("day"), "length", "topic_description", "from_caller", "to_caller", "from_caller_sex", "to_caller_birth_year")


def dimension_tab(spark: SparkSession, d: str) -> DataFrame:
    """Callers as a comma-separated dimension file with quotes, in order of conversation; the last row of a caller wins."""
    path = shared_path(spark, "callers")
    m = _t(spark, d, "swda_metadata").select("conversation_no", "from_caller", "from_caller_sex", "from_caller_birth_year").distinct().filter("from_caller is not null")
    line = F.concat(F.col("from_caller").cast("string"), F.lit(', "'), F.coalesce("from_caller_sex", F.lit("")), F.lit('", '), F.coalesce(F.col("from_caller_birth_year").cast("string"), F.lit("")))
    order = ["conversation_no", "from_caller", "from_caller_sex", "from_caller_birth_year"]
    m.repartition(1).sortWithinPartitions(*order).select(line.alias("value")).write.text(path)
    return R.read_delimited(spark, path, "caller", ["caller", "sex", "birth_year"])


def sentence_dump(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of Japanese texts as a TSV dump, read back: three to eighty characters without ASCII letters, and three to
    twenty-five pieces where their script changes."""
    import re

    path = shared_path(spark, "dump")
    s = _t(spark, d, "documents").filter("text is not null and lang = 'ja'").select(F.col("doc_id").cast("string"), "lang", F.explode(F.split("text", "[。\n\t\r]")).alias("text"))
    s.filter("text <> ''").write.option("sep", "\t").option("quote", "").option("escapeQuotes", "false").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return R.read_sentence_dump(spark, path, lambda t: re.findall("[一-鿿]+|[ァ-ヺー]+|[ぁ-ゖ]+|[^一-鿿ァ-ヺーぁ-ゖ]+", t))


def source_sentences_en(spark: SparkSession, d: str) -> DataFrame:
    """Alphabetic words in lower case of English sentences of five to thirty words, by how many are left."""
    s = _t(spark, d, "documents").filter("text is not null and lang = 'en'").select(F.explode(F.split("text", r"[.!?]\s+")).alias("s")).select(F.split(F.trim("s"), " +").alias("w"))
    kept = s.filter(C.length_band(F.col("w"), 5, 30)).select(C.source_sentence_en(F.col("w")).alias("w"))
    return kept.groupBy(F.size("w").alias("n_words")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.array_join("w", ""))).alias("n_letters"))


def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files of two kinds under a folder, one per id, in order."""
    path = shared_path(spark, "listing")
    t = _asr(spark, d).groupBy("file_id").agg(F.count(F.lit(1)).cast("string").alias("value"))
    W.write_per_file(t, f"{path}/json")
    W.write_per_file(t.filter(F.col("file_id").startswith("ALL")), f"{path}/txt")
    return R.list_files(spark, path, ("txt",)).select("file_id", "extension")


def textgrid_files(spark: SparkSession, d: str) -> DataFrame:
    """Interval rows as TextGrid files, one per recording, and read back."""
    path = shared_path(spark, "textgrids")
    W.write_textgrids(M.one_delivery(_t(spark, d, "intervals")), path)
    return TG.read_textgrids(spark, path).select("file_id", "tier_idx", "tier", "idx", "xmin", "xmax", "label")


def damaged_files(spark: SparkSession, d: str) -> DataFrame:
    """TextGrid texts, every file of a Japanese recording cut off in its middle: rows read and errors told, by file."""
    t = W.textgrid_text(M.one_delivery(_t(spark, d, "intervals")))
    cut = t.withColumn("value", F.when(F.col("file_id").startswith("ALL"), F.col("value")).otherwise(F.concat(F.substring_index("value", "xmin", 3), F.lit("xmin = 0 "))))
    return TG.intervals_of_text(cut).groupBy("file_id").agg(F.count("idx").alias("n"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))


def summary_report(spark: SparkSession, d: str) -> DataFrame:
    """Run totals and parameters as a summary JSON, written and read back."""
    path = shared_path(spark, "summary")
    W.summary_json(M.run_totals(M.candidate_stats(_t(spark, d, "candidates"))), {"threshold": "0.5", "min_gap": "0.12"}).write.text(path)
    j = spark.read.text(path, wholetext=True)
    pick = lambda k, kind: F.get_json_object("value", f"$.{k}").cast(kind)
    return j.select(pick("totals.n_files", "bigint").alias("n_files"), pick("totals.n_rows", "bigint").alias("n_rows"), pick("totals.n_predicted", "bigint").alias("n_predicted"), pick("parameters.threshold", "double").alias("threshold"))


def report_table(spark: SparkSession, d: str) -> DataFrame:
    """Act tags and how often they occur as TSV and as JSON lines, read from both."""
    u = _t(spark, d, "swda_utterance").dropDuplicates(["conversation_no", "transcript_index"])
    counts = written(C.count_desc(u, ["act_tag"]), "counts")
    tsv, lines = shared_path(spark, "report"), shared_path(spark, "report")
    W.write_csv(counts, tsv, "\t")
    W.write_json(counts, lines)
    schema = "act_tag string, n bigint"
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(tsv).withColumn("form", F.lit("tsv")).unionByName(spark.read.schema(schema).json(lines).withColumn("form", F.lit("json")))


def required_columns(spark: SparkSession, d: str) -> DataFrame:
    """Which of two schemas the tables have all columns of."""
    def lacks(name: str, schema) -> str:
        try:
            S.require(_t(spark, d, name), schema)
        except ValueError as e:
            return str(e)
        return ""

    return spark.createDataFrame([("candidates", lacks("candidates", S.CANDIDATES)), ("intervals", lacks("intervals", S.INTERVALS)), ("lexicon", lacks("lexicon", ["lex_id", "form", "reading"]))], "name string, missing string")


_ASR_ONCE = "(SELECT file_id, chunk_no, any_value(duration) AS duration, any_value(transcript) AS transcript, any_value(n_words) AS n_words, any_value(words) AS words FROM asr_json GROUP BY 1, 2)"
_EACH_WORD = f"(SELECT file_id || '_' || chunk_no AS file_id, CAST(unnest(range(len(words))) AS INTEGER) AS pos, unnest(words) AS w FROM {_ASR_ONCE})"
_SW = "(SELECT DISTINCT swda_filename, ptb_basename, conversation_no, transcript_index, act_tag, caller, utterance_index, subutterance_index, text, pos, trees, ptb_treenumbers FROM swda_utterance)"
_PLAIN = f"WITH {WORDS},\n{_located('loc', 'p')},\n{_MEASURES}"
_NINE = list(M.MEASURES)
_JA_PIECES = "[一-鿿]+|[ァ-ヺー]+|[ぁ-ゖ]+|[^一-鿿ァ-ヺーぁ-ゖ]+"

SQL = {
    "asr_json_files": f"""SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY s, pos) - 1 AS INTEGER) AS idx, s, e, label FROM (
  SELECT file_id, pos, w.start AS s, w."end" AS e, regexp_replace(w.word, '^{_WS}|{_WS}$', '', 'g') AS label FROM {_EACH_WORD}) WHERE NOT isnan(s) AND NOT isnan(e) AND e > s AND label <> ''""",
    "aligner_json_files": f"""SELECT file_id, pos AS idx, w.start AS s, w."end" AS e, w.word AS word FROM {_EACH_WORD} WHERE w.word <> '' AND w.word <> '<eps>'""",
    "file_lists": "SELECT DISTINCT file_id, unnest(['bare', 'keyed']) AS form FROM intervals",
    "candidate_csv": f"SELECT DISTINCT {', '.join(S.CANDIDATES.fieldNames()[:-1])}, nullif(skip_reason, '') AS skip_reason FROM candidates",
    "measures_csv": f"{_PLAIN} SELECT file_id AS file, {', '.join(_NINE)}, CAST(units AS INTEGER) AS total_syllables, total_duration, phonation_time, CAST(n_pauses AS INTEGER) AS n_pauses, CAST(n_mid_clause_pauses AS INTEGER) AS n_mid_clause_pauses, CAST(n_end_clause_pauses AS INTEGER) AS n_end_clause_pauses, CAST(n_clauses AS INTEGER) AS n_clauses FROM measures",
    "rounded_measures": f"{_PLAIN} SELECT file_id, {', '.join(f"CAST(printf('%.3f', {m}) AS DOUBLE) AS {m}" for m in _NINE)}, CASE WHEN n_pauses > 0 THEN printf('%.3f', MPD) ELSE 'NA' END AS mpd_label FROM measures",
    "gold_segment_files": f"WITH {WORDS}, t AS (SELECT file_id, idx, {_normal('label')} AS text FROM c) SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY idx) - 1 AS INTEGER) AS idx, text FROM t WHERE text <> ''",
    "transcript_files": f"SELECT file_id || '_' || chunk_no AS file_id, {_normal('transcript')} AS text FROM {_ASR_ONCE} WHERE transcript IS NOT NULL",
    "parallel_corpus": f"WITH RECURSIVE {_MARKUP} SELECT CAST(row_number() OVER (ORDER BY conversation_no, utterance_index, caller NULLS FIRST) - 1 AS INTEGER) AS line_no, array_to_string(words, ' ') AS words, array_to_string(labels, ' ') AS labels FROM sen",
    "swda_by_header": f"""SELECT DISTINCT conversation_no, transcript_index, replace(act_tag, '*', '') AS act_tag, nullif(caller, '') AS caller, utterance_index, subutterance_index, coalesce(text, '') AS text, CAST(CASE WHEN array_to_string(coalesce(trees, []), '|||') = '' THEN 0 ELSE len(trees) END AS INTEGER) AS n_trees,
  array_to_string(coalesce(ptb_treenumbers, []), ',') AS numbers FROM {_SW} WHERE coalesce(act_tag, '') NOT LIKE '%@%' AND utterance_index IS NOT NULL AND subutterance_index IS NOT NULL AND conversation_no IS NOT NULL AND transcript_index IS NOT NULL""",
    "swda_by_position": "SELECT DISTINCT conversation_no, nullif(caller, '') AS caller, utterance_index, nullif(text, '') AS text FROM swda_utterance WHERE utterance_index IS NOT NULL AND conversation_no IS NOT NULL",
    "metadata_csv": "SELECT DISTINCT conversation_no, strftime(talk_day, '%m%d') AS day, length, nullif(topic_description, '') AS topic_description, from_caller, to_caller, nullif(from_caller_sex, '') AS from_caller_sex, to_caller_birth_year FROM (SELECT DISTINCT * FROM swda_metadata)",
    "dimension_tab": """SELECT CAST(from_caller AS VARCHAR) AS caller, coalesce(from_caller_sex, '') AS sex, coalesce(CAST(from_caller_birth_year AS VARCHAR), '') AS birth_year FROM (
  SELECT *, row_number() OVER (PARTITION BY from_caller ORDER BY conversation_no DESC, from_caller_sex DESC NULLS LAST, from_caller_birth_year DESC NULLS LAST) AS n FROM swda_metadata WHERE from_caller IS NOT NULL) WHERE n = 1""",
    "sentence_dump": f"""SELECT DISTINCT text FROM (SELECT unnest(string_split_regex(text, '[。\\n\\t\\r]')) AS text FROM documents WHERE text IS NOT NULL AND lang = 'ja') WHERE length(text) BETWEEN 3 AND 80 AND NOT regexp_matches(text, '[A-Za-z]')
  AND len(regexp_extract_all(text, '{_JA_PIECES}')) BETWEEN 3 AND 25""",
    "source_sentences_en": r"""WITH s AS (SELECT string_split_regex(trim(unnest(string_split_regex(text, '[.!?]\s+')), ' '), ' +') AS w FROM documents WHERE text IS NOT NULL AND lang = 'en'),
k AS (SELECT list_filter(w, lambda x: regexp_full_match(x, '\p{L}+')) AS w FROM s WHERE len(w) BETWEEN 5 AND 30) SELECT CAST(len(w) AS INTEGER) AS n_words, count(*) AS n, CAST(sum(length(array_to_string(w, ''))) AS BIGINT) AS n_letters FROM k GROUP BY 1""",
    "file_listing": "SELECT DISTINCT file_id, 'txt' AS extension FROM asr_json",
    "textgrid_files": "SELECT DISTINCT file_id, tier_idx, tier, idx, xmin, xmax, label FROM intervals",
    "damaged_files": """SELECT file_id, CASE WHEN file_id LIKE 'ALL%' THEN count(DISTINCT (tier_idx, idx)) ELSE 0 END AS n, CASE WHEN file_id LIKE 'ALL%' THEN 0 ELSE 1 END AS n_errors FROM intervals GROUP BY 1""",
    "summary_report": f"SELECT count(*) AS n_files, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_predicted) AS BIGINT) AS n_predicted, 0.5::DOUBLE AS threshold FROM ({_STATS})",
    "report_table": "SELECT act_tag, n, unnest(['tsv', 'json']) AS form FROM (SELECT act_tag, count(*) AS n FROM (SELECT conversation_no, transcript_index, any_value(act_tag) AS act_tag FROM swda_utterance GROUP BY 1, 2) GROUP BY 1)",
    "required_columns": "SELECT 'candidates' AS name, '' AS missing UNION ALL SELECT 'intervals', '' UNION ALL SELECT 'lexicon', 'missing columns: reading'",
}
QUERIES = {f.__name__: f for f in (
    asr_json_files, aligner_json_files, file_lists, candidate_csv, measures_csv, rounded_measures, gold_segment_files, transcript_files, parallel_corpus, swda_by_header, swda_by_position, metadata_csv, dimension_tab, sentence_dump,
    source_sentences_en, file_listing, textgrid_files, damaged_files, summary_report, report_table, required_columns,
)}
