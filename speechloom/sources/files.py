"""Readers of the other file formats: recogniser and aligner JSON, candidate and measure CSV, id lists, texts, corpora."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechloom import schema as S
from speechloom.functions import text as T
from speechloom.operators import intervals as I
from speechloom.session import few_listing_tasks, shuffle_partitions


def _stem() -> Column:
    """File id: of the folder 'file_id=...' that a file lies in, where sinks.writers put it there, else its name's stem."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, r"/file_id=([^/]+)/", 1)
    return F.when(folder != "", F.url_decode(folder)).otherwise(T.file_stem(path))


def _whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """file_id, value of every text file under a path."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(_stem().alias("file_id"), "value")


def read_asr_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: file_id and the fields; what doesn't parse is null."""
    return spark.read.schema(S.ASR_JSON).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(path).select(_stem().alias("file_id"), "*")


def asr_words(asr: DataFrame) -> DataFrame:
    """file_id, idx, s, e, label of words that aren't blank and last, in order of start."""
    w = asr.select("file_id", F.posexplode("words").alias("pos", "w")).select("file_id", "pos", F.col("w.start").try_cast("double").alias("s"), F.col("w.end").try_cast("double").alias("e"), T.strip(F.col("w.word")).alias("label"))
    w = w.filter(~F.isnan("s") & ~F.isnan("e") & (F.col("label") != "") & (F.col("e") > F.col("s")))
    return w.select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("s", "pos")) - 1).alias("idx"), "s", "e", "label")


def read_aligner_json(spark: SparkSession, path: str) -> DataFrame:
    """file_id, idx, s, e, word of an aligner's word entries; blanks and '<eps>' left out."""
    raw = spark.read.schema(S.ALIGNER_JSON).option("multiLine", True).option("recursiveFileLookup", True).json(path).select(_stem().alias("file_id"), F.posexplode("tiers.words.entries").alias("idx", "x"))
    e = lambda i: F.get("x", F.lit(i))
    return raw.select("file_id", "idx", e(0).try_cast("double").alias("s"), e(1).try_cast("double").alias("e"), e(2).alias("word")).filter("word <> '' and word <> '<eps>'")


def read_file_list(spark: SparkSession, path: str, key: str = "all_selected") -> DataFrame:
    """Distinct file ids of a JSON list, or of the list under key of a JSON object; blanks left out."""
    text = spark.read.text(path, wholetext=True).select("value")
    ids = F.coalesce(F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")), F.from_json(F.get_json_object("value", f"$.{key}"), "array<string>"))
    return text.select(F.explode(ids).alias("file_id")).select(T.strip(F.col("file_id")).alias("file_id")).filter("file_id <> ''").distinct()


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate CSVs of a directory; file_id from the column, else from the file's name.

    Spark plans a task for every few small files; up to sixteen of these become one, as many as a shuffle has at least. No
    more, as a task holds the reader of each of its files until it ends."""
    with few_listing_tasks(spark):
        df = spark.read.schema(S.CANDIDATES).option("header", True).option("enforceSchema", False).csv(path)
    n = max(shuffle_partitions(spark), -(-df.rdd.getNumPartitions() // 16))
    return df.withColumn("file_id", F.coalesce("file_id", _stem())).coalesce(n)


def read_measures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).schema(S.CAF).csv(path)


def read_gold_segments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file_id, idx, text: one normalised segment per non-blank line, of the first of the directories that has the file."""
    every = None
    for k, p in enumerate(paths):
        one = _whole_texts(spark, p).select("file_id", F.lit(k).alias("_p"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
        every = one if every is None else every.unionByName(one)
    first = every.groupBy("file_id").agg(F.min_by("value", "_p").alias("value"))
    lines = first.select("file_id", F.posexplode(F.filter(F.transform(F.split("value", r"\r?\n"), T.normalize), lambda x: x != "")).alias("idx", "text"))
    return lines


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    return _whole_texts(spark, path).select("file_id", T.normalize(F.regexp_replace("value", "^\ufeff", "")).alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), value. Files are read in splits: lines are numbered inside each split, and splits hand on
    their number of lines."""
    raw = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value", F.lit(1).cast("bigint").alias("_one"))
    return I.along(raw, ["file"], F.col("_block"), ["_id"], line_no=("sum", "_one")).select("file", "line_no", "value")


def parallel_lines(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Lines of parallel files, one file each, joined by number (up to the shortest): line_no and a column per name."""
    out = None
    for name, p in paths.items():
        one = read_lines(spark, p).select("line_no", F.col("value").alias(name))
        out = one if out is None else out.join(one, "line_no")
    return out


def read_swda(spark: SparkSession, path: str) -> DataFrame:
    """Utterance CSVs by header, typed: multi-valued fields as arrays, stars off act tags, tags with @ left out, and rows
    without the four numbers too."""
    raw = spark.read.schema(S.SWDA_RAW).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED").csv(path)
    many = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.array()).otherwise(F.split(c, r"\|\|\|"))
    numbers = ["conversation_no", "transcript_index", "utterance_index", "subutterance_index"]
    df = raw.filter(~F.coalesce(F.col("act_tag"), F.lit("")).contains("@")).withColumns({c: F.col(c).try_cast("int") for c in numbers})
    return df.filter(" and ".join(f"{c} is not null" for c in numbers)).withColumns({"act_tag": F.replace(F.col("act_tag"), F.lit("*"), F.lit("")), "trees": many("trees"), "ptb_treenumbers": F.transform(many("ptb_treenumbers"), lambda x: x.cast("int"))})


def read_swda_positional(spark: SparkSession, path: str) -> DataFrame:
    """Utterance CSVs by the place of their columns, whatever the header calls them: conversation_no, caller,
    utterance_index, text. The header, rows of fewer than nine columns and rows without a whole conversation and utterance
    number are left out; bytes that are no text become replacement characters."""
    names = S.SWDA_COLUMNS
    raw = spark.read.schema(S.SWDA_RAW).option("header", False).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    cells = raw.select(*[F.col(n) for n in names])
    numbers = {"conversation_no": F.col(names[2]).try_cast("int"), "utterance_index": F.col(names[6]).try_cast("int")}
    return cells.select(numbers["conversation_no"].alias("conversation_no"), F.col(names[5]).alias("caller"), numbers["utterance_index"].alias("utterance_index"), F.col(names[8]).alias("text")).filter("conversation_no is not null and utterance_index is not null")


def read_swda_metadata(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(S.SWDA_METADATA_RAW).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    ints = ["conversation_no", "length", "from_caller", "to_caller", "from_caller_education", "to_caller_education", "from_caller_birth_year", "to_caller_birth_year"]
    return raw.withColumns({c: F.col(c).try_cast("int") for c in ints}).withColumn("talk_day", F.to_date(F.concat(F.lit("19"), "talk_day"), "yyyyMMdd"))


def read_delimited(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """Comma-separated dimension file without header as one row per key, the last in the file."""
    lines = read_lines(spark, path)
    cells = lines.select("line_no", F.transform(F.split("value", r",\s*"), lambda x: F.trim(F.regexp_replace(x, '"', ""))).alias("c")).filter(F.size("c") >= len(columns))
    df = cells.select("line_no", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(columns)])
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c != key]), "line_no").alias("_r")).select(key, "_r.*")


def read_sentence_dump(spark: SparkSession, path: str, tokenise: Callable[[str], list[str]] | None = None, least: int = 3, most: int = 25) -> DataFrame:
    """Third column of a TSV dump (bz2 is read as it is): 3 to 80 characters, no ASCII letters, distinct; with a
    tokeniser, of `least` to `most` pieces."""
    df = spark.read.option("sep", "\t").option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).schema("id string, lang string, text string").csv(path)
    df = df.filter(F.col("text").isNotNull() & F.length("text").between(3, 80) & ~F.col("text").rlike("[A-Za-z]")).select("text").distinct()
    if tokenise is None:
        return df

    @F.pandas_udf("int")
    def pieces(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda t: len(tokenise(t)))

    return df.filter(pieces("text").between(least, most))


def read_filler_events(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    S.require(df, S.FILLER_EVENTS)
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in S.FILLER_EVENTS])


def _path_id() -> Column:
    folder = F.regexp_extract("path", r"/file_id=([^/]+)/", 1)
    return F.when(folder != "", F.url_decode(folder)).otherwise(T.file_stem(F.col("path")))


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """file_id, path, extension of files under a directory, one per id by order of the extensions; sorted by id."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    f = f.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).filter(F.col("extension").isin(*extensions))
    rank = F.array_position(F.array(*map(F.lit, extensions)), F.col("extension"))
    return f.groupBy(_path_id().alias("file_id")).agg(F.min_by(F.struct("path", "extension"), rank).alias("_x")).select("file_id", "_x.*").orderBy("file_id")


def read_audio(spark: SparkSession, path: str, decode: "callable", rate: int = 16_000) -> DataFrame:
    """file_id, duration, samples of audio files by a decoder (bytes, rate) -> float array, run in Arrow batches."""

    @F.pandas_udf("array<float>")
    def samples(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(lambda b: decode(bytes(b), rate))

    f = spark.read.format("binaryFile").load(path).select(T.file_stem(F.col("path")).alias("file_id"), samples("content").alias("samples"))
    return f.select("file_id", (F.size("samples") / rate).alias("duration"), "samples")
