"""Corpus ETL: disfluency markup, label derivation, dialogue-act tags, speaker metadata, splits, sampling."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Brace types whose words are disfluent; POS tags without a counterpart in trees; merged act tags.
DISFLUENT_BRACES = "DFEA"
NON_TREE_TAGS = ("^PRP^BES", "^FW", "^MD", "^MD^RB", "^PRP^VBZ", "^WP$", "^NN^HVS", "NN|VBG", "^DT^BES", "^MD^VB", "^DT^JJ", "^PRP^HVS", "^NN^POS", "^WP^BES", "^NN^BES", "NN|CD", "^WDT", "^VB^PRP")
ACT_KEPT = ("qy^d", "qw^d", "b^m")
ACT_RENAMED = {"nn^e": "ng", "ny^e": "na"}
ACT_MERGED = {"qr": "qy", "fe": "ba", "oo": "oo_co_cc", "co": "oo_co_cc", "cc": "oo_co_cc", "fx": "sv", "aap": "aap_am", "am": "aap_am", "arp": "arp_nd", "nd": "arp_nd", **dict.fromkeys(("fo", "o", "fw", '"', "by", "bc"), 'fo_o_fw_"_by_bc')}

_LEX = re.compile(r"\{([A-Za-z])\s|([\[\]+}])|--|[^\s\[\]+{}/#<>]+|.", re.S)


def parse_markup(text: str | None) -> tuple[list[str], list[int]] | None:
    """(words, labels) of an annotated utterance, 1: disfluent; None if no word is left.

    Words are disfluent inside {D, {F, {E, {A braces, before the plus of the innermost open repair, or if cut off
    (ending in a hyphen). Noise in angle brackets and the final slash are gone."""
    text = re.sub(r"<<[^>]*>>|<[^>]*>|\[\[|\]\]", "", re.sub(r"\s*/\s*$", "", (text or "").strip()))
    words, labels, repairs, braces = [], [], [], []
    for m in _LEX.finditer(text):
        token, brace, sign = m.group(0), m.group(1), m.group(2)
        if brace:
            braces.append(brace.upper())
        elif sign == "}" and braces:
            braces.pop()
        elif sign == "[":
            repairs.append(True)
        elif sign == "+" and repairs:
            repairs[-1] = False
        elif sign == "]" and repairs:
            repairs.pop()
        elif sign or token == "--" or token.isspace() or token in "{/#<>":
            continue
        else:
            word = token.lower().lstrip("\"'([").rstrip("\"')].,;:!?")
            if word.strip("-") or word not in ("", "-", "--"):
                words.append(word)
                labels.append(int(any(b in DISFLUENT_BRACES for b in braces) or bool(repairs and repairs[-1]) or word.endswith("-")))
    return (words, labels) if words else None


def markup(text: Column) -> Column:
    """parse_markup as STRUCT<words ARRAY<STRING>, labels ARRAY<INT>>; null where no word is left."""

    @F.pandas_udf("words array<string>, labels array<int>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            got = [parse_markup(t) or (None, None) for t in s]
            yield pd.DataFrame({"words": [g[0] for g in got], "labels": [g[1] for g in got]})

    return run(text)


def utterance_texts(rows: DataFrame) -> DataFrame:
    """Sub-utterances joined to one text per (conversation_no, caller, utterance_index), in row order; rows without an
    utterance index are left out, repeated deliveries count once."""
    once = rows.filter("utterance_index is not null").groupBy("conversation_no", "transcript_index").agg(F.min("caller").alias("caller"), F.min("utterance_index").alias("utterance_index"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("transcript_index", "text")))
    return once.groupBy("conversation_no", "caller", "utterance_index").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def split_of_conversation(conversation_no: Column) -> Column:
    return F.when(conversation_no.between(4000, 4199), "test").when(conversation_no.between(4500, 4999), "valid").otherwise("train")


def labelled_sentences(texts: DataFrame) -> DataFrame:
    """utterance_texts with split, words, labels, disfluent: at least two words, train only if disfluent."""
    t = texts.withColumn("m", markup(F.col("text"))).filter(F.size("m.words") >= 2).withColumn("split", split_of_conversation(F.col("conversation_no")))
    t = t.withColumn("disfluent", F.exists("m.labels", lambda x: x == 1))
    return t.filter((F.col("split") != "train") | F.col("disfluent")).select("conversation_no", "caller", "utterance_index", "split", "m.words", "m.labels", "disfluent")


def split_stats(sentences: DataFrame) -> DataFrame:
    return sentences.groupBy("split").agg(F.count(F.lit(1)).alias("total"), F.count_if("disfluent").alias("disfluent"), F.count_if(~F.col("disfluent")).alias("fluent"))


def derive_labels(disfluent: Column, fluent: Column) -> Column:
    """0/1 labels of a disfluent word array against its fluent one, matched from the right; null where the fluent words
    aren't a subsequence. The fluent text 'None' stands for no words."""
    none = F.expr("cast(array() as array<string>)")
    flu = F.when((F.size(fluent) == 1) & (F.get(fluent, F.lit(0)) == "None"), none).otherwise(fluent)
    start = F.struct(F.size(flu).alias("left"), F.expr("cast(array() as array<int>)").alias("labels"))

    def step(acc: Column, w: Column) -> Column:
        same = (acc["left"] > 0) & (F.get(flu, acc["left"] - 1) == w)
        return F.struct((acc["left"] - F.when(same, 1).otherwise(0)).alias("left"), F.concat(F.array(F.when(same, 0).otherwise(1)), acc["labels"]).alias("labels"))

    done = F.aggregate(F.reverse(disfluent), start, step)
    return F.when(done["left"] == 0, done["labels"])


def majority_labels(tokens: DataFrame, keys: list[str], word: str, label: str) -> DataFrame:
    """Word labels from sub-token labels: 1 where more than half are; ties are fluent. keys, word, label."""
    return tokens.groupBy(*keys, word).agg((F.sum(label) * 2 > F.count(label)).cast("int").alias(label))


def act_tag(tag: Column) -> Column:
    """Simplified dialogue-act tag of the first of several: secondary ^ parts, brackets and stars gone, like tags merged."""
    first = F.split(F.trim(tag), r"\s*[,;]\s*", 2)[0]
    bare = F.regexp_replace(F.regexp_replace(first, r"(.)\^.*", "$1"), r"[()@*]", "")
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.when(first.isin(*ACT_KEPT), first).otherwise(F.coalesce(F.try_element_at(table(ACT_RENAMED), first), F.try_element_at(table(ACT_MERGED), bare), bare))


def plain_words(text: Column) -> Column:
    """Words at white space, annotation signs gone."""
    return F.split(F.trim(F.regexp_replace(text, r"[+/}\[\]]|\{\w", "")), r"\s+")


def tagged_words(pos: Column, wordnet: bool = False) -> Column:
    """ARRAY<STRUCT<word, tag>> of 'word/TAG' text; other shapes are left out. wordnet: tags as n, v, a, r where known."""
    parts = F.filter(F.transform(F.split(F.trim(pos), r"\s+"), lambda x: F.split(x, "/")), lambda p: F.size(p) == 2)
    t = lambda p: F.lower(p[1])
    tag = (lambda p: F.when(t(p).startswith("v"), "v").when(t(p).startswith("n"), "n").when(t(p).startswith("j"), "a").when(t(p).startswith("rb"), "r").otherwise(t(p))) if wordnet else (lambda p: p[1])
    return F.transform(parts, lambda p: F.struct(p[0].alias("word"), tag(p).alias("tag")))


def tree_words(trees: Column) -> Column:
    """ARRAY<STRUCT<word, tag>> of the leaves '(TAG word)' of bracketed trees."""
    leaves = F.regexp_extract_all(F.array_join(trees, " "), F.lit(r"\(([^\s()]+) ([^\s()]+)\)"), F.lit(0))
    cut = F.transform(leaves, lambda x: F.split(F.regexp_replace(x, r"[()]", ""), " "))
    return F.transform(cut, lambda p: F.struct(p[1].alias("word"), p[0].alias("tag")))


def tree_matches(pos: Column, trees: Column) -> Column:
    """Whether a single tree has the words and tags of the POS text, notation aside."""
    bare = lambda x: F.struct(F.regexp_replace(x["word"], "-$", "").alias("word"), x["tag"].alias("tag"))
    a = F.transform(F.filter(tagged_words(pos), lambda x: ~x["tag"].isin(*NON_TREE_TAGS) & (x["word"] != "--")), bare)
    b = F.transform(F.filter(tree_words(trees), lambda x: ~x["tag"].isin("-NONE-", "-DFL-")), bare)
    return F.coalesce((F.size(trees) == 1) & (a == b), F.lit(False))


def caller_metadata(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """rows with sex, education, birth_year and dialect_area of their caller: the to_ side if the caller ends in B."""
    fields = ("sex", "education", "birth_year", "dialect_area")
    once = metadata.dropDuplicates(["conversation_no"])
    m = once.select("conversation_no", *[F.col(f"{side}_caller_{f}").alias(f"_{side}_{f}") for side in ("from", "to") for f in fields])
    is_b = F.coalesce(F.col("caller").endswith("B"), F.lit(False))
    return rows.join(m, "conversation_no", "left").select(*rows.columns, *[F.when(is_b, F.col(f"_to_{f}")).otherwise(F.col(f"_from_{f}")).alias(f"caller_{f}") for f in fields])


def conversation_star(conversations: DataFrame, callers: DataFrame) -> DataFrame:
    """conversations (conversation_no, from_caller, to_caller, ...) with the attributes of both callers (caller, ...),
    prefixed from_ and to_."""
    side = lambda p: callers.select(F.col("caller").alias(f"{p}_caller"), *[F.col(c).alias(f"{p}_{c}") for c in callers.columns if c != "caller"])
    return conversations.join(side("from"), "from_caller", "left").join(side("to"), "to_caller", "left")


def last_row_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in order."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def count_desc(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per group, most first; ties in group order."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *columns)


def match_rates(df: DataFrame, by: list[str], matches: Column) -> DataFrame:
    """by, n_match, n_mismatch, pct_match, pct_mismatch; where nothing tells, it is a mismatch."""
    g = df.groupBy(*by).agg(F.count_if(F.coalesce(matches, F.lit(False))).alias("n_match"), F.count(F.lit(1)).alias("_n"))
    share = lambda c: F.lit(100.0) * c / F.col("_n")
    return g.select(*by, "n_match", (F.col("_n") - F.col("n_match")).alias("n_mismatch"), share(F.col("n_match")).alias("pct_match"), share(F.col("_n") - F.col("n_match")).alias("pct_mismatch"))


def word_errors(df: DataFrame) -> DataFrame:
    """Per word: missed, false_positive, correct. df: words, auto, gold (arrays of equal length)."""
    x = df.select(F.explode(F.arrays_zip("words", "auto", "gold")).alias("x")).select("x.*")
    return x.groupBy(F.col("words").alias("word")).agg(F.count_if((F.col("gold") == 1) & (F.col("auto") == 0)).alias("missed"), F.count_if((F.col("gold") == 0) & (F.col("auto") == 1)).alias("false_positive"), F.count_if((F.col("gold") == 1) & (F.col("auto") == 1)).alias("correct"))


def sample_per_group(df: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows of each group by lowest MD5 of 'seed:key': the same rows on every run, layout and engine.

    Each task keeps only n rows of a group before anything moves."""
    h = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")))
    w = Window.partitionBy(*by).orderBy("_h", key)
    return h.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n", "_h")


def length_band(words: Column, least: int, most: int) -> Column:
    return F.size(words).between(least, most)


def source_sentence_en(words: Column) -> Column:
    """Alphabetic tokens in lower case of an English corpus sentence."""
    # \z: '$' also matches before a line break at the end.
    return F.transform(F.filter(words, lambda w: w.rlike(r"^\p{L}+\z")), F.lower)


def is_source_sentence_ja(text: Column) -> Column:
    """3 to 80 characters, no ASCII letters."""
    return F.length(text).between(3, 80) & ~text.rlike("[A-Za-z]")


def event_label(label: Column, positive: tuple[str, ...], negative: tuple[str, ...]) -> Column:
    """1, 0, or null for labels in neither set."""
    return F.when(label.isin(*positive), 1).when(label.isin(*negative), 0)


def plain_split(split: Column) -> Column:
    s = F.lower(F.trim(split))
    return F.when(s.isin("train", "training"), "train").when(s.isin("valid", "validation", "val", "dev"), "valid").when(s == "test", "test")


def first_third_to_test(df: DataFrame, line: str) -> DataFrame:
    """df (valid lines, numbered from 0) with split: the first third of the lines is test, the rest valid."""
    third = df.agg(F.expr("count(1) div 3")).scalar()
    return df.withColumn("split", F.when(F.col(line) < third, "test").otherwise("valid"))


def prefix_in_vocabulary(words: DataFrame, vocabulary: DataFrame, least: int = 2) -> DataFrame:
    """Each word (of at least 3 characters) with its shortest proper prefix of at least `least` characters that is in
    the vocabulary (column word): word, prefix."""
    w = words.select("word").distinct().filter(F.length("word") >= 3)
    p = w.select("word", F.explode(F.transform(F.sequence(F.lit(least), F.length("word") - 1), lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("prefix"))
    v = vocabulary.select(F.col("word").alias("prefix")).distinct()
    return p.join(v, "prefix", "left_semi").groupBy("word").agg(F.min_by("prefix", F.length("prefix")).alias("prefix"))


def readings(tokens: DataFrame, reading_of: "callable") -> DataFrame:
    """First reading of each kanji token: word, reading (katakana, at least 3 characters). reading_of runs once per
    distinct token, in Arrow batches."""

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        return s.map(reading_of)

    t = tokens.select("word").distinct().filter(F.col("word").rlike(r"[\x{4e00}-\x{9fff}]") & (F.length("word") >= 2))
    return t.withColumn("reading", read("word")).filter(F.length("reading") >= 3)


def lemmas(words: DataFrame, lemmatise: "callable") -> DataFrame:
    """words (word, tag, ...) with lemma by a lemmatiser (word, tag) -> lemma, run in Arrow batches; null words have none."""

    @F.pandas_udf("string")
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for w, t in it:
            yield pd.Series([None if a is None else lemmatise(a, b or "") for a, b in zip(w, t)])

    return words.withColumn("lemma", run("word", "tag"))


def keep_files(df: DataFrame, ids: DataFrame | None, empty_keeps_all: bool) -> DataFrame:
    """df's rows with a file_id in ids. ids None: all rows; empty ids: all rows or none, as empty_keeps_all says."""
    if ids is None or (empty_keeps_all and ids.isEmpty()):
        return df
    return df.join(ids.select("file_id").distinct(), "file_id", "left_semi")


def drop_files(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("file_id").distinct(), "file_id", "left_anti")


def presence(ids: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """file_id, status: 'ok', or 'no <name>' of the first table that lacks the file."""
    out, status = ids.select("file_id").distinct(), F.lit("ok")
    for name, t in tables.items():
        out = out.join(t.select("file_id").distinct().withColumn(f"_has_{name}", F.lit(True)), "file_id", "left")
    for name in reversed(tables):
        status = F.when(F.col(f"_has_{name}").isNull(), f"no {name}").otherwise(status)
    return out.select("file_id", status.alias("status"))


def conversation_of_file(name: Column) -> Column:
    """Conversation number of 'sw_<n>_<number>' names; null for others."""
    return F.regexp_extract(name, r"sw_\d+_(\d+)", 1).try_cast("int")


def first_examples(df: DataFrame, condition: Column, order: list[str], n: int) -> DataFrame:
    """The first n rows in order that meet the condition."""
    return df.filter(condition).orderBy(*order).limit(n)


def subtoken_labels(labels: Column, word_ids: Column, ignored: int = -100) -> Column:
    """Labels of sub-tokens: each takes its word's, special ones (null word) the ignored label."""
    return F.transform(word_ids, lambda w: F.coalesce(F.get(labels, w), F.lit(ignored)))
