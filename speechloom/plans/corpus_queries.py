"""Queries over the dialogue and text tables: markup, tags, metadata, splits, vocabularies, alignment, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechloom.functions import text as T
from speechloom.operators import agreement as A
from speechloom.operators import align as L
from speechloom.operators import clauses as CL
from speechloom.operators import corpus as C
from speechloom.operators import injectors as J
from speechloom.operators import intervals as I
from speechloom.operators import models as MO
from speechloom.session import written
from speechloom.streaming import periods as P


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _utterances(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "swda_utterance")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """asr_json once per chunk: file_id, chunk_no, transcript, words ARRAY<STRUCT<word, s, e>> of usable words."""
    a = _t(spark, d, "asr_json").dropDuplicates(["file_id", "chunk_no"])
    w = F.filter("words", lambda x: x["word"].isNotNull() & (F.trim(x["word"]) != "") & ~F.isnan(x["start"]) & ~F.isnan(x["end"]) & (x["end"] > x["start"]))
    return a.select("file_id", "chunk_no", "duration", "transcript", F.transform(w, lambda x: F.struct(x["word"].alias("word"), x["start"].alias("s"), x["end"].alias("e"))).alias("words"))


def _place() -> Column:
    """Place of a word in its recording, by chunk and position."""
    return F.shiftleft(F.col("chunk_no").cast("bigint"), 32) + F.col("pos")


def _line(array: str) -> Column:
    """An array as one line of text."""
    return F.array_join(F.transform(array, lambda x: x.cast("string")), " ")


def utterance_concat(spark: SparkSession, d: str) -> DataFrame:
    return C.utterance_texts(_utterances(spark, d))


def markup_labels(spark: SparkSession, d: str) -> DataFrame:
    s = C.labelled_sentences(C.utterance_texts(_utterances(spark, d)))
    return s.withColumns({"words": _line("words"), "labels": _line("labels")})


def split_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.split_stats(C.labelled_sentences(C.utterance_texts(_utterances(spark, d))))


def act_tags(spark: SparkSession, d: str) -> DataFrame:
    u = _utterances(spark, d).filter(~F.col("act_tag").contains("@")).dropDuplicates(["conversation_no", "transcript_index"])
    return u.groupBy("act_tag", C.act_tag(F.col("act_tag")).alias("simple_tag")).agg(F.count(F.lit(1)).alias("n"))


def caller_metadata(spark: SparkSession, d: str) -> DataFrame:
    u = _utterances(spark, d).select("conversation_no", "transcript_index", "caller").distinct()
    m = C.caller_metadata(u, _t(spark, d, "swda_metadata").distinct())
    return m.groupBy("caller_sex", "caller_education").agg(F.count(F.lit(1)).alias("n"))


def pos_words(spark: SparkSession, d: str) -> DataFrame:
    """Words and tags of POS texts, and whether a lone tree agrees with them."""
    u = _utterances(spark, d).filter("pos is not null").dropDuplicates(["conversation_no", "transcript_index"])
    x = u.select("conversation_no", "transcript_index", C.tree_matches(F.col("pos"), F.col("trees")).alias("matches"), F.explode(C.tagged_words(F.col("pos"), wordnet=True)).alias("t"))
    return x.groupBy("t.tag", "matches").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("t.word").alias("n_words"))


def clause_heads(spark: SparkSession, d: str) -> DataFrame:
    """Clause heads of POS-tagged utterances under a flat parse: the first verb is the root, nouns after it its objects,
    later verbs its conjuncts with the nouns after them."""
    u = _utterances(spark, d).filter("pos is not null").dropDuplicates(["conversation_no", "transcript_index"])
    t = u.select(F.col("conversation_no").cast("string").alias("file_id"), F.col("transcript_index").alias("sent"), F.posexplode(C.tagged_words(F.col("pos"))).alias("i", "t")).select("file_id", "sent", "i", F.col("t.word").alias("text"), F.col("t.tag").alias("tag"))
    w = Window.partitionBy("file_id", "sent").orderBy("i")
    verb = F.col("tag").startswith("VB")
    t = t.withColumn("v", F.last(F.when(verb, F.col("i")), True).over(w)).withColumn("root", F.first(F.when(verb, F.col("i")), True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    dep = F.when(F.col("i") == F.col("root"), "ROOT").when(verb, "conj").when(F.col("tag").startswith("NN") & F.col("v").isNotNull(), "obj").otherwise("dep")
    t = t.filter("root is not null").select("file_id", "sent", "i", "text", F.col("text").alias("lemma"), F.when(verb, "VERB").otherwise("X").alias("pos"), "tag", dep.alias("dep"), F.coalesce(F.when(dep == "conj", F.col("root")).when(dep == "obj", F.col("v")), F.col("root")).alias("head_i"))
    return CL.clause_heads_en(t)


def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.count_desc(_t(spark, d, "swda_metadata").distinct(), ["from_caller_education", "from_caller_dialect_area"])


def topk_words(spark: SparkSession, d: str) -> DataFrame:
    """The thirty commonest words of the utterances' plain text; ties by the word."""
    u = _utterances(spark, d).filter("text is not null").dropDuplicates(["conversation_no", "transcript_index"])
    w = u.select(F.explode(C.plain_words(F.col("text"))).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return w.orderBy(F.desc("n"), "word").limit(30)


def star_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with the attributes of both callers from a caller dimension (last row of a caller wins)."""
    m = _t(spark, d, "swda_metadata")
    side = lambda p: m.select(F.col(f"{p}_caller").alias("caller"), F.col(f"{p}_caller_sex").alias("sex"), F.col(f"{p}_caller_birth_year").alias("birth_year"), F.struct("conversation_no", F.lit(p)).alias("_o"))
    callers = C.last_row_per_key(side("from").unionByName(side("to")).filter("caller is not null"), "caller", "_o").drop("_o")
    return C.conversation_star(m.select("conversation_no", "from_caller", "to_caller", "length").distinct(), callers)


def id_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Recordings with and without hand-checked tiers, and how many rows they have."""
    ids = _t(spark, d, "intervals").select("file_id").distinct()
    c = _t(spark, d, "candidates").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    return c.join(ids, "file_id", "left_semi").withColumn("checked", F.lit(True)).unionByName(c.join(ids, "file_id", "left_anti").withColumn("checked", F.lit(False)))


def id_setops(spark: SparkSession, d: str) -> DataFrame:
    """Recordings in both of two tables, only in one, in either."""
    a, b = _t(spark, d, "candidates").select("file_id"), _t(spark, d, "asr_json").select("file_id")
    rows = [a.intersect(b).withColumn("side", F.lit("both")), a.subtract(b).withColumn("side", F.lit("candidates")), b.subtract(a).withColumn("side", F.lit("asr")), a.union(b).distinct().withColumn("side", F.lit("either"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def file_presence(spark: SparkSession, d: str) -> DataFrame:
    """Which recordings have hand-checked tiers and candidates."""
    return C.presence(_t(spark, d, "asr_json"), {"tiers": _t(spark, d, "intervals"), "candidates": _t(spark, d, "candidates")})


def files_kept(spark: SparkSession, d: str) -> DataFrame:
    """Candidate rows of recordings kept by a list, kept by an empty one, and left by an exclusion."""
    c, ids = _t(spark, d, "candidates").select("file_id"), _t(spark, d, "intervals").select("file_id")
    n = lambda df, name: df.groupBy("file_id").agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(name))
    return n(C.keep_files(c, ids, False), "listed").unionByName(n(C.keep_files(c, ids.limit(0), True), "empty keeps all")).unionByName(n(C.keep_files(c, ids.limit(0), False), "empty keeps none")).unionByName(n(C.drop_files(c, ids), "excluded"))


def conversation_files(spark: SparkSession, d: str) -> DataFrame:
    """Conversation number in the file names against that of the rows."""
    u = _utterances(spark, d).select("swda_filename", "conversation_no", C.conversation_of_file(F.col("swda_filename")).alias("in_name"))
    return u.groupBy((F.col("in_name") == F.col("conversation_no")).alias("agrees")).agg(F.countDistinct("swda_filename").alias("n_files"))


def first_questions(spark: SparkSession, d: str) -> DataFrame:
    """The first fifteen questions in order of conversation and row."""
    u = _utterances(spark, d).select("conversation_no", "transcript_index", "act_tag").distinct()
    return C.first_examples(u, F.col("act_tag").startswith("q"), ["conversation_no", "transcript_index"], 15)


def dedup_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sentences of five to thirty words of the English texts."""
    s = _t(spark, d, "documents").filter("lang = 'en'").select(F.explode(F.split("text", r"[.!?]\s+")).alias("s"))
    words = F.split(F.trim(F.regexp_replace(F.lower("s"), "[^a-z ]+", " ")), " +")
    return s.select(words.alias("w")).filter(C.length_band(F.col("w"), 5, 30)).select(F.array_join("w", " ").alias("sentence")).distinct()


def source_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Short Japanese lines without ASCII letters, by length."""
    s = _t(spark, d, "documents").filter("lang = 'ja'").select(F.explode(F.split("text", "。")).alias("s")).filter(C.is_source_sentence_ja(F.col("s")))
    return s.distinct().groupBy(F.length("s").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def vocabulary_prefixes(spark: SparkSession, d: str) -> DataFrame:
    lex = _t(spark, d, "lexicon").select(F.col("form").alias("word"))
    return C.prefix_in_vocabulary(lex, lex)


def token_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Aligner tokens and clean forms of the ASCII words of the recogniser."""
    w = _t(spark, d, "asr_json").select(F.explode("words").alias("w")).select(F.col("w.word").alias("word")).filter(F.col("word").rlike(r"^[\x20-\x7e]+$")).distinct()
    return w.select("word", T.aligner_token_en(F.col("word")).alias("token"), T.clean_word_en(F.col("word")).alias("clean"), T.compare_key(F.col("word")).alias("compare"))


def lexicon_fillers(spark: SparkSession, d: str) -> DataFrame:
    """Recogniser words that are fillers, by lexicon, with their number and mean length in seconds."""
    w = _t(spark, d, "asr_json").dropDuplicates(["file_id", "chunk_no"]).select(F.explode("words").alias("w")).select("w.*").filter("word is not null and not isnan(start) and not isnan(`end`) and `end` > start")
    strict = T.in_filler_lexicon(F.col("word"), T.FILLERS_CONSERVATIVE)
    return w.filter(T.in_filler_lexicon(F.col("word"), T.FILLERS_PERMISSIVE)).groupBy(T.surface(F.col("word")).alias("filler"), strict.alias("conservative")).agg(F.count(F.lit(1)).alias("n"), (F.sum(I.exact(F.col("end") - F.col("start"))).cast("double") / F.count(F.lit(1))).alias("mean_s"))


def filler_choice(spark: SparkSession, d: str) -> DataFrame:
    """Filler tokens for the gaps between neighbouring words of a chunk."""
    pools = (("えー", "あー", "んー"), ("えっと", "えーと", "うーん"), ("えっと", "えーと", "うーん"))
    w = _chunks(spark, d).select("file_id", "chunk_no", F.posexplode("words").alias("idx", "w")).select("file_id", "chunk_no", "idx", "w.*")
    right = F.lead("word").over(I._order(["file_id", "chunk_no"], "idx"))
    g = L.lead_gap(w, ["file_id", "chunk_no"]).withColumn("right", right).filter("gap >= 0.4")
    g = g.withColumn("i", F.explode(F.sequence(F.lit(0), T.gap_filler_count(F.col("gap")) - 1)))
    return g.select("file_id", "chunk_no", "idx", "i", T.choose_filler(F.col("gap"), T.aligner_token_ja(F.col("word")), T.aligner_token_ja(F.col("right")), F.col("i"), pools).alias("filler"))


def _ops(column: str, op: str) -> Column:
    return F.size(F.filter(column, lambda p: p["op"] == op))


def word_error_rates(spark: SparkSession, d: str) -> DataFrame:
    """Word error rate of each English chunk's words against its transcript."""
    c = _chunks(spark, d).filter("transcript is not null and file_id like 'ALL%'").select("file_id", "chunk_no", F.split(T.normalize(F.col("transcript")), " ").alias("ref"), F.transform("words", lambda x: T.normalize(x["word"])).alias("hyp"))
    c = c.withColumn("x", L.edit_align(F.col("ref"), F.col("hyp")))
    return c.select("file_id", "chunk_no", L.word_error_rate(F.col("x"), F.col("ref")).alias("wer"), *[_ops("x", o).alias(f"n_{o.lower()}") for o in "CSDI"])


def boundary_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Boundary scores of sentence starts in English transcripts against words cut at pauses, by task and overall."""
    c = _chunks(spark, d).filter("transcript is not null and size(words) > 1 and file_id like 'ALL%'")
    cut = lambda by: F.aggregate("words", F.expr("cast(array() as array<struct<e:double,ws:array<string>>>)"), lambda acc, w: F.when((F.size(acc) > 0) & (w["s"] - F.element_at(acc, -1)["e"] < by), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(w["e"].alias("e"), F.concat(F.element_at(acc, -1)["ws"], F.array(w["word"])).alias("ws"))))).otherwise(F.concat(acc, F.array(F.struct(w["e"].alias("e"), F.array(w["word"]).alias("ws"))))), lambda acc: F.transform(acc, lambda x: x["ws"]))
    seg = c.select("file_id", "chunk_no", F.split(T.normalize(F.col("transcript")), " ").alias("canonical"), cut(0.25).alias("gold"), cut(0.6).alias("auto"))
    pairs = L.boundary_pairs(seg, ["file_id", "chunk_no"], "canonical", "gold", "auto")
    return A.scores(A.confusion(A.with_overall(pairs.withColumn("task", T.task_en(F.col("file_id"))), "task"), ["task"]))


def gold_to_time(spark: SparkSession, d: str) -> DataFrame:
    """Times of stretches of ten words of English transcripts, found through the words spoken."""
    c = _chunks(spark, d).filter("transcript is not null and size(words) > 0 and file_id like 'ALL%'").withColumn("t", F.split(T.normalize(F.col("transcript")), " "))
    c = c.select("file_id", "chunk_no", "words", F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / 10).cast("int")), lambda i: F.slice("t", i * 10 + 1, 10)).alias("gold"))
    return L.segments_to_time(c, ["file_id", "chunk_no"], "gold", "words")


def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """Hand-checked words matched to recogniser words of one form less than two seconds apart."""
    from speechloom.operators import measures as M

    gold = M.word_rows(_t(spark, d, "intervals")).filter(~F.col("pause")).select("file_id", "idx", "s", "e", T.compare_key(F.col("label")).alias("token"))
    w = _chunks(spark, d).select("file_id", "chunk_no", F.posexplode("words").alias("pos", "w")).select("file_id", _place().alias("idx"), "w.s", "w.e", T.compare_key(F.col("w.word")).alias("token"))
    return L.greedy_matches(gold, w, ["file_id"])


def timing_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median and 90th percentile of start and end errors of matched words, in milliseconds."""
    x = written(greedy_match(spark, d).select(F.explode(F.array("start_error", "end_error")).alias("v")), "errors")
    mean = (F.sum(I.exact(F.col("v"))).cast("double") / F.count("v") * 1000).alias("mean_ms")
    p = A.percentiles(x, [], (0.5, 0.9)).select((F.col("p0") * 1000).alias("median_ms"), (F.col("p1") * 1000).alias("p90_ms"))
    # Two frames of one row each as one row.
    names = ("n", "mean_ms", "median_ms", "p90_ms")
    return x.agg(F.count("v").alias("n"), mean).unionByName(p, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])


def aligner_map_back(spark: SparkSession, d: str) -> DataFrame:
    """Hand-checked words mapped to the recogniser's words in one forward pass, with up to five joined."""
    from speechloom.operators import measures as M

    words = M.word_rows(_t(spark, d, "intervals")).filter(~F.col("pause")).select("file_id", "idx", F.lit(0).alias("sub"), T.aligner_token_ja(F.col("label")).alias("token"), F.col("label").alias("word"), "s", "e")
    heard = _chunks(spark, d).select("file_id", "chunk_no", F.posexplode("words").alias("pos", "w")).select("file_id", _place().alias("idx"), T.aligner_token_ja(F.col("w.word")).alias("token"), "w.s", "w.e")
    return L.aligner_times(words, heard, ["file_id"], joins=5)


def timeline_repair(spark: SparkSession, d: str) -> DataFrame:
    """Chunk words as a gapless tier."""
    c = _chunks(spark, d).filter("size(words) > 0")
    last = F.array_max(F.transform("words", lambda w: w["e"]))
    rows = F.transform(F.sort_array(F.transform("words", lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), T.clean_word_ja(w["word"]).alias("label")))), lambda w: w)
    return c.select("file_id", "chunk_no", F.explode(L.repair_timeline(rows, last)).alias("x")).select("file_id", "chunk_no", "x.*")


def retokenised(spark: SparkSession, d: str) -> DataFrame:
    """Recogniser words cut where their script changes, time shared by length."""
    import re

    w = _chunks(spark, d).select("file_id", "chunk_no", F.posexplode("words").alias("idx", "w")).select("file_id", "chunk_no", "idx", "w.*")
    return L.retokenise(w, ["file_id", "chunk_no"], lambda t: re.findall("[一-鿿]+|[ァ-ヺー]+|[ぁ-ゖ]+|[^一-鿿ァ-ヺーぁ-ゖ]+", t))


def label_derivation(spark: SparkSession, d: str) -> DataFrame:
    """Labels derived from utterances and their fluent words, against the labels of the markup."""
    s = C.labelled_sentences(C.utterance_texts(_utterances(spark, d)))
    fluent = F.transform(F.filter(F.arrays_zip("words", "labels"), lambda x: x["labels"] == 0), lambda x: x["words"])
    return s.select("conversation_no", "caller", "utterance_index", C.derive_labels(F.col("words"), fluent).alias("derived"), "labels").withColumns({"derived": F.when(F.col("derived").isNotNull(), _line("derived")), "labels": _line("labels")})


def word_errors(spark: SparkSession, d: str) -> DataFrame:
    """Words whose derived and marked-up labels differ or agree."""
    s = C.labelled_sentences(C.utterance_texts(_utterances(spark, d)))
    return C.word_errors(s.select("words", F.transform("words", lambda w: F.when(w.isin("uh", "um", "er", "hmm"), 1).otherwise(0)).alias("auto"), F.col("labels").alias("gold")))


def injected_en(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic disfluencies in English sentences, with labels derived from the clean ones."""
    s = dedup_sentences(spark, d).withColumn("w", F.split("sentence", " "))
    x = s.withColumn("disfluent", J.injected(F.col("w"), F.col("sentence"), 42, J.ENGLISH)).filter("disfluent is not null")
    return x.select("sentence", "disfluent", C.derive_labels(F.split("disfluent", " "), F.col("w")).alias("labels")).withColumn("labels", _line("labels"))


def injected_ja(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic disfluencies in the recogniser's Japanese word lists, in stretches of twenty words."""
    w = _chunks(spark, d).filter("file_id not like 'ALL%' and size(words) > 0").select("file_id", "chunk_no", F.transform("words", lambda x: x["word"]).alias("w"))
    s = w.select("file_id", "chunk_no", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 20).cast("int")), lambda i: F.slice("w", i * 20 + 1, 20))).alias("part", "w"))
    return s.select("file_id", "chunk_no", "part", J.injected(F.col("w"), F.concat_ws("/", "file_id", "chunk_no", "part"), 42, J.JAPANESE).alias("disfluent")).filter("disfluent is not null")


def disfluency_tagging(spark: SparkSession, d: str) -> DataFrame:
    """Utterances with a stand-in labeller's labels and cleaned text."""
    s = C.labelled_sentences(C.utterance_texts(_utterances(spark, d))).select("conversation_no", "caller", "utterance_index", "words")
    return MO.disfluency_labels(s, "words", lambda: lambda ws: [[int(w.rstrip(",.") in ("uh", "um", "er", "hmm") or w.endswith("-")) for w in x] for x in ws]).withColumns({"words": _line("words"), "labels": _line("labels")})


def subtoken_majority(spark: SparkSession, d: str) -> DataFrame:
    """Word labels from labels of their letters (vowels 1): 1 where more than half are."""
    lex = _t(spark, d, "lexicon").filter("lang = 'en'").select("lex_id", F.explode(F.split("form", "")).alias("c")).select("lex_id", F.lit(0).alias("word_id"), F.col("c").rlike("[aeiou]").cast("int").alias("label"))
    return C.majority_labels(lex, ["lex_id"], "word_id", "label")


def icc_agreement(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    return A.icc_2_1(p, ["l_returnflag"])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))


def pearson_bias_mae(spark: SparkSession, d: str) -> DataFrame:
    return A.pearson(_pairs(spark, d), ["l_returnflag"])


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return A.spearman(_pairs(spark, d), ["l_returnflag"])


def spearman_windows(spark: SparkSession, d: str) -> DataFrame:
    """Spearman with ranks made by ordering each group in one task."""
    return A.spearman_small(_pairs(spark, d), ["l_returnflag"])


def kappa_prf(spark: SparkSession, d: str) -> DataFrame:
    """Predictions against a lower threshold, overall and by task."""
    c = _t(spark, d, "candidates").filter("prob_filler is not null and not isnan(prob_filler)").select("file_id", "gap_index", "island_index", "prob_filler").distinct()
    c = c.select(T.task_ja(F.col("file_id")).alias("task"), (F.col("prob_filler") >= 0.5).alias("auto"), (F.col("prob_filler") >= 0.3).alias("gold"))
    return A.scores(A.confusion(A.with_overall(c, "task"), ["task"]))


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    """How well the length of an island tells predicted fillers, by task."""
    c = _t(spark, d, "candidates").filter("island_duration is not null and not isnan(island_duration)").select("file_id", "gap_index", "island_index", "island_duration", "pred_filler").distinct()
    return A.roc_auc(c.withColumn("task", T.task_ja(F.col("file_id"))), ["task"], "island_duration", F.col("pred_filler") == 1)


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return A.class_weights(_t(spark, d, "candidates").select("file_id", "gap_index", "island_index", "pred_filler").distinct(), "pred_filler")


def sample_documents(spark: SparkSession, d: str) -> DataFrame:
    """Five documents of each source by seeded MD5."""
    return C.sample_per_group(_t(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 5, 42)


def split_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "lexicon").select((F.col("lex_id") - 1).alias("line_no"), "form")
    return C.first_third_to_test(lines, "line_no").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last"))


def split_rules(spark: SparkSession, d: str) -> DataFrame:
    """Conversations shifted through the id ranges of the splits."""
    m = _t(spark, d, "swda_metadata").select((F.col("conversation_no") * 7 % 1500 + 3800).alias("c")).distinct()
    return m.groupBy(C.split_of_conversation(F.col("c")).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Events by the number in their JSON, with what isn't one left null."""
    e = _t(spark, d, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


def session_periods(spark: SparkSession, d: str) -> DataFrame:
    """Periods of the users' events, each lasting value minutes, as the streaming operator makes them."""
    e = _t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), (F.col("value") * 60).alias("seconds"))
    p = P.streaming_periods(e, "user_id", "at", "seconds")
    return p.select("user_id", F.unix_micros("period_start").alias("start_us"), "n")


def surface_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Lexicon forms in hiragana, whether they hold kanji, and a mispronounced form where a rule applies."""
    rules = (("ツ", "チュ"), ("ズ", "ジュ"), ("ッ", ""), ("ン", "ヌ"))
    f = F.col("form")
    return _t(spark, d, "lexicon").filter("lang = 'ja'").select("lex_id", T.to_hiragana(f).alias("hiragana"), T.has_kanji(f).alias("kanji"), T.mispronounce(f, rules).alias("heard"))


_WS = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_EDGES = r"""\s\x{3000}\x{3001}\x{3002}\x{ff0c}\x{ff0e}\x{ff01}\x{ff1f}\x{300c}-\x{300f}\x{3008}\x{3009}\x{ff08}\x{ff09}.,!?\-"''()\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"""
_CHUNK_WORDS = """
ch AS (SELECT file_id, chunk_no, any_value(words) AS words FROM asr_json GROUP BY 1, 2),
cw AS (SELECT file_id, chunk_no, unnest(words) AS w FROM ch)"""
_ONCE = "(SELECT conversation_no, transcript_index, any_value(act_tag) AS act_tag, any_value(text) AS text, any_value(pos) AS pos, any_value(trees) AS trees FROM swda_utterance GROUP BY 1, 2)"
_SCORES = """SELECT task, tp, fp, fn, tn, (tp + tn) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 1) AS "precision", coalesce(tp / nullif(tp + fn, 0), 1) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1,
  CASE WHEN abs(1 - x) > 1e-12 THEN ((tp + tn) / n - x) / (1 - x) ELSE 1.0 END AS kappa
FROM (SELECT *, tp + fp + fn + tn AS n, ((tp + fp)::DOUBLE * (tp + fn) + (n - tp - fp)::DOUBLE * (n - tp - fn)) / (n::DOUBLE * n) AS x FROM k)"""
_KEPT = "(SELECT DISTINCT file_id, gap_index, island_index, prob_filler, pred_filler, island_duration FROM candidates)"
_PAIRS = "(SELECT l_returnflag, l_quantity AS a, l_extendedprice / 1000 AS b FROM lineitem)"
_TASK = "CASE WHEN contains(file_id, 'ST1') THEN 'ST1' WHEN contains(file_id, 'ST2') THEN 'ST2' ELSE 'OTHER' END"

SQL = {
    "utterance_concat": """SELECT conversation_no, caller, utterance_index, string_agg(text, ' ' ORDER BY transcript_index) AS text FROM (
  SELECT conversation_no, transcript_index, min(caller) AS caller, min(utterance_index) AS utterance_index, min(coalesce(text, '')) AS text FROM swda_utterance WHERE utterance_index IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2, 3""",
    "act_tags": f"""WITH u AS (SELECT act_tag, trim(string_split_regex(act_tag, '\\s*[,;]\\s*')[1]) AS f FROM {_ONCE} WHERE NOT contains(act_tag, '@')),
b AS (SELECT act_tag, f, regexp_replace(regexp_replace(f, '(.)\\^.*', '\\1', 'g'), '[()@*]', '', 'g') AS t FROM u)
SELECT act_tag, CASE WHEN f IN ('qy^d', 'qw^d', 'b^m') THEN f WHEN f = 'nn^e' THEN 'ng' WHEN f = 'ny^e' THEN 'na' WHEN t = 'qr' THEN 'qy' WHEN t = 'fe' THEN 'ba' WHEN t IN ('oo', 'co', 'cc') THEN 'oo_co_cc' WHEN t = 'fx' THEN 'sv'
  WHEN t IN ('aap', 'am') THEN 'aap_am' WHEN t IN ('arp', 'nd') THEN 'arp_nd' WHEN t IN ('fo', 'o', 'fw', '"', 'by', 'bc') THEN 'fo_o_fw_"_by_bc' ELSE t END AS simple_tag, count(*) AS n FROM b GROUP BY 1, 2""",
    "caller_metadata": """WITH u AS (SELECT DISTINCT conversation_no, transcript_index, caller FROM swda_utterance), m AS (SELECT DISTINCT * FROM swda_metadata)
SELECT CASE WHEN coalesce(caller, '') LIKE '%B' THEN to_caller_sex ELSE from_caller_sex END AS caller_sex, CASE WHEN coalesce(caller, '') LIKE '%B' THEN to_caller_education ELSE from_caller_education END AS caller_education, count(*) AS n
FROM u LEFT JOIN m USING (conversation_no) GROUP BY 1, 2""",
    "clause_heads": f"""WITH u AS (SELECT conversation_no, transcript_index, list_filter(list_transform(string_split_regex(trim(pos), '\\s+'), lambda x: string_split(x, '/')), lambda p: len(p) = 2) AS t FROM {_ONCE} WHERE pos IS NOT NULL),
t AS (SELECT CAST(conversation_no AS VARCHAR) AS file_id, transcript_index AS sent, CAST(unnest(range(len(t))) AS INTEGER) AS i, unnest(t)[2] AS tag FROM u),
v AS (SELECT *, tag LIKE 'VB%' AS verb, min(CASE WHEN tag LIKE 'VB%' THEN i END) OVER (PARTITION BY file_id, sent) AS root, max(CASE WHEN tag LIKE 'VB%' THEN i END) OVER (PARTITION BY file_id, sent ORDER BY i) AS v FROM t),
o AS (SELECT DISTINCT file_id, sent, v FROM v WHERE tag LIKE 'NN%' AND v IS NOT NULL)
SELECT file_id, sent, i, 'independent' AS clause_type FROM v WHERE i = root UNION ALL SELECT v.file_id, v.sent, v.i, 'coordinated_vp' FROM v JOIN o ON o.file_id = v.file_id AND o.sent = v.sent AND o.v = v.i WHERE v.verb AND v.i <> v.root
UNION ALL SELECT file_id, sent, i, 'nonfinite_participle' FROM v WHERE false""",
    "pos_words": f"""WITH u AS (SELECT list_filter(list_transform(string_split_regex(trim(pos), '\\s+'), lambda x: string_split(x, '/')), lambda p: len(p) = 2) AS t, trees FROM {_ONCE} WHERE pos IS NOT NULL),
v AS (SELECT t, coalesce(len(trees) = 1 AND array_to_string(list_transform(t, lambda p: p[1] || '/' || p[2]), ' ') = array_to_string(list_transform(regexp_extract_all(array_to_string(trees, ' '), '\\(([^\\s()]+) ([^\\s()]+)\\)'), lambda x: regexp_replace(x, '\\(([^\\s()]+) ([^\\s()]+)\\)', '\\2/\\1')), ' '), false) AS matches FROM u),
x AS (SELECT matches, unnest(t) AS p FROM v), y AS (SELECT matches, p[1] AS word, lower(p[2]) AS g FROM x)
SELECT CASE WHEN g LIKE 'v%' THEN 'v' WHEN g LIKE 'n%' THEN 'n' WHEN g LIKE 'j%' THEN 'a' WHEN g LIKE 'rb%' THEN 'r' ELSE g END AS tag, matches, count(*) AS n, count(DISTINCT word) AS n_words FROM y GROUP BY 1, 2""",
    "filler_choice": f"""WITH {_CHUNK_WORDS}, o AS (SELECT file_id, chunk_no, row_number() OVER () AS r, w FROM cw), z AS (SELECT * FROM o WHERE w.word IS NOT NULL AND trim(w.word) <> '' AND NOT isnan(w.start) AND NOT isnan(w."end") AND w."end" > w.start),
n AS (SELECT file_id, chunk_no, CAST(row_number() OVER (PARTITION BY file_id, chunk_no ORDER BY r) - 1 AS INTEGER) AS idx, w.start AS s, w."end" AS e, regexp_replace(w.word, '^[{_EDGES}]+|[{_EDGES}]+$', '', 'g') AS tok FROM z),
g AS (SELECT file_id, chunk_no, idx, tok, lead(tok) OVER q AS nxt, lead(s) OVER q - e AS gap FROM n WINDOW q AS (PARTITION BY file_id, chunk_no ORDER BY idx)),
k AS (SELECT *, CAST(unnest(range(CAST(least(floor((gap - 0.35::DOUBLE) / 0.55::DOUBLE) + 1, 3) AS INTEGER))) AS INTEGER) AS i FROM g WHERE gap >= 0.4::DOUBLE),
t AS (SELECT *, list_sum(list_transform(string_split(tok || '|' || nxt || '|' || CAST(CAST(round_even(gap * 100, 0) AS BIGINT) AS VARCHAR) || '|' || CAST(i AS VARCHAR), ''), lambda c: unicode(c))) AS h FROM k)
SELECT file_id, chunk_no, idx, i, CASE WHEN gap < 0.8::DOUBLE THEN ['えー', 'あー', 'んー'][CAST(h % 3 AS INTEGER) + 1] ELSE ['えっと', 'えーと', 'うーん'][CAST(h % 3 AS INTEGER) + 1] END AS filler FROM t""",
    "group_counts": "SELECT from_caller_education, from_caller_dialect_area, count(*) AS n FROM (SELECT DISTINCT * FROM swda_metadata) GROUP BY 1, 2",
    "topk_words": f"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(trim(regexp_replace(text, '[+/}}\\[\\]]|\\{{\\w', '', 'g')), '\\s+')) AS word FROM {_ONCE} WHERE text IS NOT NULL) WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 30""",
    "star_metadata": """WITH s AS (SELECT from_caller AS caller, from_caller_sex AS sex, from_caller_birth_year AS birth_year, conversation_no, 'from' AS p FROM swda_metadata UNION ALL SELECT to_caller, to_caller_sex, to_caller_birth_year, conversation_no, 'to' FROM swda_metadata),
d AS (SELECT DISTINCT ON (caller) caller, sex, birth_year FROM s WHERE caller IS NOT NULL ORDER BY caller, conversation_no DESC, p DESC)
SELECT m.conversation_no, m.from_caller, m.to_caller, m.length, a.sex AS from_sex, a.birth_year AS from_birth_year, b.sex AS to_sex, b.birth_year AS to_birth_year
FROM (SELECT DISTINCT conversation_no, from_caller, to_caller, length FROM swda_metadata) m LEFT JOIN d a ON m.from_caller = a.caller LEFT JOIN d b ON m.to_caller = b.caller""",
    "id_semi_anti": "SELECT file_id, count(*) AS n, file_id IN (SELECT file_id FROM intervals) AS checked FROM candidates GROUP BY 1",
    "id_setops": """SELECT file_id, 'both' AS side FROM (SELECT file_id FROM candidates INTERSECT SELECT file_id FROM asr_json) UNION ALL SELECT file_id, 'candidates' FROM (SELECT file_id FROM candidates EXCEPT SELECT file_id FROM asr_json)
UNION ALL SELECT file_id, 'asr' FROM (SELECT file_id FROM asr_json EXCEPT SELECT file_id FROM candidates) UNION ALL SELECT file_id, 'either' FROM (SELECT file_id FROM candidates UNION SELECT file_id FROM asr_json)""",
    "file_presence": "SELECT DISTINCT file_id, CASE WHEN file_id NOT IN (SELECT file_id FROM intervals) THEN 'no tiers' WHEN file_id NOT IN (SELECT file_id FROM candidates) THEN 'no candidates' ELSE 'ok' END AS status FROM asr_json",
    "files_kept": """SELECT file_id, count(*) AS n, 'listed' AS rule FROM candidates WHERE file_id IN (SELECT file_id FROM intervals) GROUP BY 1 UNION ALL SELECT file_id, count(*), 'empty keeps all' FROM candidates GROUP BY 1
UNION ALL SELECT file_id, count(*), 'excluded' FROM candidates WHERE file_id NOT IN (SELECT file_id FROM intervals) GROUP BY 1""",
    "conversation_files": "SELECT try_cast(nullif(regexp_extract(swda_filename, 'sw_[0-9]+_([0-9]+)', 1), '') AS INTEGER) = conversation_no AS agrees, count(DISTINCT swda_filename) AS n_files FROM swda_utterance GROUP BY 1",
    "first_questions": "SELECT DISTINCT conversation_no, transcript_index, act_tag FROM swda_utterance WHERE act_tag LIKE 'q%' ORDER BY conversation_no, transcript_index LIMIT 15",
    "dedup_sentences": """WITH s AS (SELECT unnest(string_split_regex(text, '[.!?]\\s+')) AS s FROM documents WHERE lang = 'en'), w AS (SELECT string_split_regex(trim(regexp_replace(lower(s), '[^a-z ]+', ' ', 'g'), ' '), ' +') AS w FROM s)
SELECT DISTINCT array_to_string(w, ' ') AS sentence FROM w WHERE len(w) BETWEEN 5 AND 30""",
    "source_sentences": "SELECT CAST(length(s) AS INTEGER) AS length, count(*) AS n FROM (SELECT DISTINCT s FROM (SELECT unnest(string_split(text, '。')) AS s FROM documents WHERE lang = 'ja') WHERE length(s) BETWEEN 3 AND 80 AND NOT regexp_matches(s, '[A-Za-z]')) GROUP BY 1",
    "vocabulary_prefixes": "SELECT a.form AS word, arg_min(b.form, length(b.form)) AS prefix FROM lexicon a JOIN lexicon b ON starts_with(a.form, b.form) AND length(b.form) BETWEEN 2 AND length(a.form) - 1 WHERE length(a.form) >= 3 GROUP BY 1",
    "token_normalise": f"""WITH {_CHUNK_WORDS}, w AS (SELECT DISTINCT unnest(words).word AS word FROM asr_json)
SELECT word, regexp_replace(regexp_replace(lower(trim(word)), '^[^a-z0-9'']+|[^a-z0-9'']+$', '', 'g'), '''+', '''', 'g') AS token, lower(regexp_replace(regexp_replace(word, '^[^\\w]+|[^\\w]+$', '', 'g'), '[^\\w'']', '', 'g')) AS clean,
  regexp_replace(lower(trim(word)), '[^\\w'']', '', 'g') AS compare FROM w WHERE regexp_matches(word, '^[\\x20-\\x7e]+$')""",
    "lexicon_fillers": f"""WITH {_CHUNK_WORDS}, x AS (SELECT regexp_replace(translate(lower(regexp_replace(w.word, '^[{_WS}]+|[{_WS}]+$', '', 'g')), '〜～ 　', 'ーー'), '^[\\s.,!?！？。、・「」『』()（）\\[\\]【】]+|[\\s.,!?！？。、・「」『』()（）\\[\\]【】]+$', '', 'g') AS f, w."end" - w.start AS d FROM cw
  WHERE w.word IS NOT NULL AND NOT isnan(w.start) AND NOT isnan(w."end") AND w."end" > w.start)
SELECT f AS filler, f IN ({', '.join(f"'{t}'" for t in T.FILLERS_CONSERVATIVE)}) AS conservative, count(*) AS n, sum(CAST(d AS DECIMAL(28,9)))::DOUBLE / count(*) AS mean_s FROM x WHERE f IN ({', '.join(f"'{t}'" for t in T.FILLERS_PERMISSIVE)}) GROUP BY 1, 2""",
    "subtoken_majority": "SELECT lex_id, 0 AS word_id, CAST(sum(CASE WHEN regexp_matches(c, '[aeiou]') THEN 1 ELSE 0 END) * 2 > count(*) AS INTEGER) AS label FROM (SELECT lex_id, unnest(string_split(form, '')) AS c FROM lexicon WHERE lang = 'en') GROUP BY 1",
    "icc_agreement": f"""WITH c AS (SELECT l_returnflag, avg(a) AS ca, avg(b) AS cb, (avg(a) + avg(b)) / 2 AS gm, count(*) AS n FROM {_PAIRS} GROUP BY 1),
s AS (SELECT p.l_returnflag, any_value(n) AS n, 2 * sum(((a + b) / 2 - gm) ** 2) AS ssr, any_value(n * ((ca - gm) ** 2 + (cb - gm) ** 2)) AS ssc, sum((a - gm) ** 2 + (b - gm) ** 2) AS sst FROM {_PAIRS} p JOIN c USING (l_returnflag) GROUP BY 1),
m AS (SELECT l_returnflag, n, ssr / (n - 1) AS msr, ssc AS msc, (sst - ssr - ssc) / (n - 1) AS mse FROM s)
SELECT l_returnflag, n, (msr - mse) / (msr + mse + 2.0::DOUBLE / n * (msc - mse)) AS icc_2_1 FROM m""",
    "pearson_bias_mae": f"SELECT l_returnflag, count(*) AS n, corr(a, b) AS pearson_r, avg(a - b) AS bias, avg(abs(a - b)) AS mae, avg(a) AS mean_a, avg(b) AS mean_b FROM {_PAIRS} GROUP BY 1",
    "kappa_prf": f"""WITH k AS (SELECT task, count(*) FILTER (a AND g) AS tp, count(*) FILTER (a AND NOT g) AS fp, count(*) FILTER (NOT a AND g) AS fn, count(*) FILTER (NOT a AND NOT g) AS tn FROM (
  SELECT unnest(['Overall', {_TASK}]) AS task, prob_filler >= 0.5::DOUBLE AS a, prob_filler >= 0.3::DOUBLE AS g FROM {_KEPT} WHERE prob_filler IS NOT NULL AND NOT isnan(prob_filler)) GROUP BY 1) {_SCORES}""",
    "roc_auc": f"""WITH x AS (SELECT {_TASK} AS task, island_duration AS v, pred_filler = 1 AS p FROM {_KEPT} WHERE island_duration IS NOT NULL AND NOT isnan(island_duration)),
r AS (SELECT task, p, rank() OVER (PARTITION BY task ORDER BY v) + (count(*) OVER (PARTITION BY task, v) - 1) / 2 AS r FROM x)
SELECT task, count(*) FILTER (p) AS n_pos, count(*) FILTER (NOT p) AS n_neg, (sum(r) FILTER (p) - count(*) FILTER (p)::DOUBLE * (count(*) FILTER (p) + 1) / 2) / (count(*) FILTER (p)::DOUBLE * count(*) FILTER (NOT p)) AS auc FROM r GROUP BY 1""",
    "class_weights": f"WITH c AS (SELECT pred_filler, count(*) AS n FROM {_KEPT} GROUP BY 1) SELECT pred_filler, n, (SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * greatest(n, 1)) AS weight FROM c",
    "split_lines": "SELECT split, count(*) AS n, max(line_no) AS last FROM (SELECT lex_id - 1 AS line_no, CASE WHEN lex_id - 1 < (SELECT count(*) // 3 FROM lexicon) THEN 'test' ELSE 'valid' END AS split FROM lexicon) GROUP BY 1",
    "split_rules": "SELECT CASE WHEN c BETWEEN 4000 AND 4199 THEN 'test' WHEN c BETWEEN 4500 AND 4999 THEN 'valid' ELSE 'train' END AS split, count(*) AS n FROM (SELECT DISTINCT conversation_no * 7 % 1500 + 3800 AS c FROM swda_metadata) GROUP BY 1",
    "json_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS top FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
    "session_periods": """WITH i AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 60 * 1000000) AS BIGINT) AS e, event_id FROM events WHERE value > 0),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i), g AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(s) AS start_us, count(*) AS n FROM g GROUP BY user_id, g""",
    "surface_scripts": """SELECT lex_id, translate(form, 'ァアィイゥウェエォオカガキギクグケゲコゴサザシジスズセゼソゾタダチヂッツヅテデトドナニヌネノハバパヒビピフブプヘベペホボポマミムメモャヤュユョヨラリルレロヮワヰヱヲンヴヵヶ',
'ぁあぃいぅうぇえぉおかがきぎくぐけげこごさざしじすずせぜそぞただちぢっつづてでとどなにぬねのはばぱひびぴふぶぷへべぺほぼぽまみむめもゃやゅゆょよらりるれろゎわゐゑをんゔゕゖ') AS hiragana, regexp_matches(form, '[一-鿿]') AS kanji,
CASE WHEN contains(form, 'ツ') THEN regexp_replace(form, 'ツ', 'チュ') WHEN contains(form, 'ズ') THEN regexp_replace(form, 'ズ', 'ジュ') WHEN contains(form, 'ッ') THEN regexp_replace(form, 'ッ', '') WHEN contains(form, 'ン') THEN regexp_replace(form, 'ン', 'ヌ') END AS heard FROM lexicon WHERE lang = 'ja'""",
}
_SPEARMAN = f"""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY a) + (count(*) OVER (PARTITION BY l_returnflag, a) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY b) + (count(*) OVER (PARTITION BY l_returnflag, b) - 1) / 2 AS b FROM {_PAIRS})
SELECT l_returnflag, count(*) AS n, corr(a, b) AS spearman_rho FROM r GROUP BY 1"""
SQL |= {"spearman": _SPEARMAN, "spearman_windows": _SPEARMAN}
QUERIES = {f.__name__: f for f in (
    utterance_concat, markup_labels, split_stats, act_tags, caller_metadata, pos_words, clause_heads, group_counts, topk_words, star_metadata, id_semi_anti, id_setops, file_presence, files_kept, conversation_files, first_questions, dedup_sentences, source_sentences, vocabulary_prefixes,
    token_normalise, lexicon_fillers, filler_choice, word_error_rates, boundary_agreement, gold_to_time, greedy_match, timing_percentiles, aligner_map_back, timeline_repair, retokenised, label_derivation, word_errors,
    injected_en, injected_ja, disfluency_tagging, subtoken_majority, icc_agreement, pearson_bias_mae, spearman, spearman_windows, kappa_prf, roc_auc, class_weights, sample_documents, split_lines, split_rules, json_props,
    session_periods, surface_scripts,
)}
