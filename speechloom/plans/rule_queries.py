"""Queries of rules and helpers: unions, reasons, phone units, gaps at the edges, clause rules, events and clips, tokens."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechloom.functions import text as T
from speechloom.operators import agreement as A
from speechloom.operators import align as L
from speechloom.operators import clauses as CL
from speechloom.operators import corpus as C
from speechloom.operators import intervals as I
from speechloom.operators import measures as M
from speechloom.operators import models as MO
from speechloom.plans import interval_queries as IQ
from speechloom.plans.corpus_queries import _chunks, _line, _place
from speechloom.plans.interval_queries import _COVER, _KEPT_CANDIDATES, WORDS, K, _located, _merge_sql
from speechloom.plans.sequence_sql import _CHUNKS, _MARKUP, _token_ja
from speechloom.session import shuffle_partitions, written
from speechloom.streaming import periods as P


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def filler_union(spark: SparkSession, d: str) -> DataFrame:
    """Time that spoken or predicted fillers cover, as one interval set."""
    said, predicted = IQ._fillers(spark, d)
    return I.union_merge(said, predicted, K, 0.02)


def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Why candidates aren't scored, by the rules, against the reason they came with."""
    c = _t(spark, d, "candidates").select("file_id", "gap_index", "island_index", "vad_occupancy", "n_voiced_islands", "prob_filler", "skip_reason").distinct()
    return c.groupBy("skip_reason", M.skip_reason(F.col("vad_occupancy"), F.col("n_voiced_islands"), F.col("prob_filler")).alias("by_rule")).agg(F.count(F.lit(1)).alias("n"))


def phone_unit_words(spark: SparkSession, d: str) -> DataFrame:
    """Units of words by their phones: a phone tier in which each letter of a word takes its share of the time (vowel
    letters as AH1, others as T) is put beside the word tier and counted."""
    i = _t(spark, d, "intervals")
    words = written(M.word_rows(i), "words")
    n = F.length("label")
    letters = words.filter(~F.col("pause") & (n > 0) & (F.col("e") > F.col("s"))).select("file_id", "s", "e", n.alias("n"), "label", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    at = lambda k: F.when(k == F.col("n"), F.col("e")).otherwise(F.col("s") + (F.col("e") - F.col("s")) * k / F.col("n"))
    vowel = F.lower(F.substring(F.col("label"), F.col("k") + 1, F.lit(1))).isin(*"aeiou")
    tier = letters.select("file_id", F.lit("Phones").alias("tier"), F.lit(9).alias("tier_idx"), F.row_number().over(Window.partitionBy("file_id", "s", "e").orderBy("k")).alias("idx"), at(F.col("k")).alias("xmin"), at(F.col("k") + 1).alias("xmax"), F.when(vowel, "AH1").otherwise("T").alias("label"))
    phones = M.pick_tier(i.select(*tier.columns).unionByName(tier), M.PHONE_TIERS).select("file_id", F.col("xmin").alias("s"), F.col("xmax").alias("e"), "label")
    return M.phone_units(words, phones).groupBy("file_id").agg(F.sum("units").alias("units"), F.count_if(F.col("units") > 0).alias("n_words"))


def edge_gap_fillers(spark: SparkSession, d: str) -> DataFrame:
    """Filler tokens that fit before the first word, between words and after the last word of a chunk with a duration."""
    c = _chunks(spark, d).filter("size(words) > 0 and duration is not null and not isnan(duration)")
    words = c.select("file_id", "chunk_no", F.posexplode("words").alias("idx", "w")).select("file_id", "chunk_no", "idx", "w.s", "w.e")
    start = words.groupBy("file_id", "chunk_no").agg(F.min("s").alias("low"))
    bounds = start.join(c.select("file_id", "chunk_no", "duration"), ["file_id", "chunk_no"]).select("file_id", "chunk_no", (F.col("low") - 0.5).alias("low"), (F.col("low") + F.col("duration")).alias("high"))
    g = L.gaps_with_edges(words, ["file_id", "chunk_no"], bounds)
    return g.select("file_id", "chunk_no", "place", T.gap_filler_count(F.col("gap")).alias("n")).filter("n > 0").groupBy("file_id", "chunk_no", "place").agg(F.sum("n").alias("n"))


def pause_agreement_files(spark: SparkSession, d: str) -> DataFrame:
    """Per recording of the recogniser: pauses, those located alike with tolerances of 0.15 s and 0.02 s, their share;
    recordings without pauses have zeros."""
    p, c = written(M.long_pauses(IQ._words(spark, d)), "pauses"), written(M.clause_rows(_t(spark, d, "intervals")), "clauses")
    both = I.classify(p, c, K, "idx", 0.15).withColumnRenamed("location", "auto").join(I.classify(p, c, K, "idx", 0.02).withColumnRenamed("location", "gold"), ["file_id", "s", "e"])
    return A.file_agreement(_t(spark, d, "asr_json").select("file_id"), both)


def caller_match_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often the callers of a conversation have the same schooling, by the first one's region."""
    m = _t(spark, d, "swda_metadata").distinct()
    return C.match_rates(m, ["from_caller_dialect_area"], F.col("from_caller_education") == F.col("to_caller_education"))


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates as labelled events of an episode and split, and recordings with audio as both and n samples (a tone of
    100 samples a second over its chunks' words)."""
    split = T.task_ja(F.col("file_id"))
    e = _t(spark, d, "candidates").select("file_id", "gap_index", "island_index", "candidate_start", "candidate_end").distinct().withColumns({"episode": F.col("file_id"), "split": split})
    length = F.array_max(F.transform("words", lambda w: F.when(~F.isnan(w["end"]), w["end"])))
    a = _t(spark, d, "asr_json").groupBy("file_id").agg(F.max(length).alias("seconds")).filter("seconds is not null")
    return e, a.filter(~F.col("file_id").startswith("VNM")).select(F.col("file_id").alias("episode"), split.alias("split"), F.greatest(F.ceil(F.col("seconds") * 100), F.lit(1)).cast("bigint").alias("n"))


def event_matches(spark: SparkSession, d: str) -> DataFrame:
    """Events with and without audio of their episode and split."""
    events, audio = _events(spark, d)
    return MO.match_counts(events, audio, ["episode", "split"])


def event_features(spark: SparkSession, d: str) -> DataFrame:
    """Clips of events cut from their recording's samples: how many gave features, and why others didn't."""
    events, audio = _events(spark, d)
    keys, size = ["episode", "split"], MO.BLOCK
    # Blocks find their task and place before they have samples, so that these are neither shuffled nor sorted;
    # the number of tasks is given, as rows that are yet without samples look like one task's work.
    blocks = audio.select(*keys, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("block"))
    blocks = blocks.repartition(shuffle_partitions(spark), *keys, "block").sortWithinPartitions(*keys, "block")
    first = F.col("block") * F.lit(size).cast("bigint")
    wave = F.transform(F.sequence(first + 1, F.least(first + size, F.col("n"))), lambda i: F.sin(i.cast("double")).cast("float"))
    clips = MO.event_clips(events, blocks.select(*keys, "block", wave.alias("samples")), audio, keys, "candidate_start", "candidate_end", 100, 0.1)
    made = MO.clip_features(clips.select("dropped", "clip"), "clip", 100, lambda: lambda c, rate: np.array([len(c), float(np.abs(c).max())]))
    return made.groupBy("dropped").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("features")).alias("n_values"))


def tree_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """Lemmas of tagged words by a stand-in rule (endings of plurals and verb forms fall), from POS texts and from trees."""
    u = _t(spark, d, "swda_utterance").filter("pos is not null").dropDuplicates(["conversation_no", "transcript_index"])
    rule = lambda w, tag: re.sub("(ing|ed|s)$", "", w.lower()) if tag[:1] in "VN" and len(w) > 4 else w.lower()
    of = lambda words, name: C.lemmas(u.select(F.explode(words).alias("x")).select("x.word", "x.tag"), rule).withColumn("source", F.lit(name))
    both = of(C.tagged_words(F.col("pos")), "pos").unionByName(of(C.tree_words(F.col("trees")), "tree"))
    return both.groupBy("source", "lemma").agg(F.count(F.lit(1)).alias("n"))


def clause_heads_ja(spark: SparkSession, d: str) -> DataFrame:
    """Clause heads of Japanese chunks under a flat parse: forms in ました or ます are verbs, the last one the root, earlier
    ones clauses before it, other words belong to the next verb."""
    w = _chunks(spark, d).filter("file_id not like 'ALL%'").select("file_id", F.col("chunk_no").alias("sent"), F.posexplode("words").alias("i", "w")).select("file_id", "sent", "i", F.col("w.word").alias("text"))
    verb = F.col("text").rlike("(ました|ます)$")
    s = Window.partitionBy("file_id", "sent").orderBy(F.desc("i"))
    w = w.withColumn("next", F.last(F.when(verb, F.col("i")), True).over(s)).withColumn("root", F.first(F.when(verb, F.col("i")), True).over(s.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).filter("root is not null")
    dep = F.when(F.col("i") == F.col("root"), "ROOT").when(verb, "advcl").otherwise("obl")
    t = w.select("file_id", "sent", "i", "text", F.col("text").alias("lemma"), F.when(verb, "VERB").otherwise("NOUN").alias("pos"), F.lit("").alias("tag"), dep.alias("dep"), F.when(dep == "obl", F.coalesce("next", "root")).otherwise(F.col("root")).alias("head_i"))
    return CL.clause_heads_ja(t).withColumn("i", F.col("i").cast("int"))


def clause_drops_ja(spark: SparkSession, d: str) -> DataFrame:
    """Japanese clauses that stay or go, cut after sixty characters."""
    c = M.clause_rows(_t(spark, d, "intervals")).filter(F.col("label").rlike("[ぁ-ヿ一-鿿]"))
    ok = CL.valid_clause_ja(F.col("label"), F.col("label").rlike("ました|ます|です"), F.lit("IND"), F.lit(True))
    return c.select("file_id", "idx", ok.alias("kept"), CL.cut_long(F.col("label"), 60).alias("text"))


def clause_recovery(spark: SparkSession, d: str) -> DataFrame:
    """English clauses with those of fewer than three words taken for fragments, recovered."""
    c = M.clause_rows(_t(spark, d, "intervals")).filter(~F.col("label").rlike("[ぁ-ヿ一-鿿]"))
    words = F.split(T.normalize(F.col("label")), " ")
    kind = F.when(F.size(words) < 4, "fragment").otherwise("independent")
    return CL.recover_clauses(c.select("file_id", "idx", kind.alias("clause_type"), F.col("label").alias("text"), F.size(words).alias("n_words"), F.col("label").rlike("ed( |$)").alias("has_verb")))


def clause_splits(spark: SparkSession, d: str) -> DataFrame:
    """English transcripts in stretches of words, cut in two at their eleventh word where they are long."""
    c = _chunks(spark, d).filter("transcript is not null and file_id like 'ALL%'")
    parts = CL.split_long_clause(F.split(T.normalize(F.col("transcript")), " "), F.lit(10))
    return c.select("file_id", "chunk_no", F.posexplode(parts).alias("part", "w")).select("file_id", "chunk_no", "part", F.size("w").alias("n_words"))


def original_words(spark: SparkSession, d: str) -> DataFrame:
    """Spans of five words, fillers left out, as spans over all words of a chunk."""
    w = _chunks(spark, d).select("file_id", "chunk_no", F.posexplode("words").alias("o", "w")).filter(~F.lower("w.word").isin("uh", "um", "er", "hmm"))
    kept = w.select("file_id", "chunk_no", (F.row_number().over(Window.partitionBy("file_id", "chunk_no").orderBy("o")) - 1).alias("p"), "o")
    spans = kept.groupBy("file_id", "chunk_no", F.expr("p div 5").cast("int").alias("idx")).agg(F.min("p").alias("first"), F.max("p").alias("last"))
    return CL.to_original_words(kept, spans, ["file_id", "chunk_no"])


def boundary_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Ends of clauses matched one-to-one to starts of pauses no more than 0.15 s away."""
    g = M.clause_rows(_t(spark, d, "intervals")).select("file_id", F.col("e").alias("at"))
    return CL.tolerant_matches(g, M.long_pauses(IQ._words(spark, d)).select("file_id", F.col("s").alias("at")), K, 0.15)


def kanji_readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings of kanji words by a stand-in: one katakana a character and a long mark."""
    return C.readings(_t(spark, d, "lexicon").select(F.col("form").alias("word")), lambda w: "".join(chr(0x30A1 + ord(c) % 80) for c in w) + "ー")


def subtoken_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Labels of sub-tokens where every word is two of them between special ones."""
    s = C.labelled_sentences(C.utterance_texts(_t(spark, d, "swda_utterance")))
    none = F.array(F.lit(None).cast("int"))
    ids = F.concat(none, F.flatten(F.transform("words", lambda _, i: F.array(i, i))), none)
    return s.withColumn("sub", C.subtoken_labels(F.col("labels"), ids)).select("conversation_no", "caller", "utterance_index", _line("sub").alias("labels"))


def sample_positions(spark: SparkSession, d: str) -> DataFrame:
    """Samples at which candidates begin and end at 16 kHz, within ten seconds."""
    c = _t(spark, d, "candidates").filter("candidate_start is not null and candidate_end is not null and not isnan(candidate_start) and not isnan(candidate_end)").select("file_id", "gap_index", "island_index", "candidate_start", "candidate_end").distinct()
    at = lambda x: MO.sample_index(F.col(x), 16_000, F.lit(160_000).cast("bigint"))
    return c.select("file_id", "gap_index", "island_index", at("candidate_start").alias("first"), at("candidate_end").alias("last"))


def event_labels(spark: SparkSession, d: str) -> DataFrame:
    """Events by their label as positive, negative or neither, and by a split in plain words."""
    e = _t(spark, d, "events")
    split = F.when(F.col("value") < 10, " Training").when(F.col("value") < 50, "dev").when(F.col("value") < 90, "TEST").otherwise("other")
    return e.groupBy(C.event_label(F.col("event_type"), ("purchase", "signup"), ("view", "click")).alias("label"), C.plain_split(split).alias("split")).agg(F.count(F.lit(1)).alias("n"))


def aligner_map_back_en(spark: SparkSession, d: str) -> DataFrame:
    """English hand-checked words mapped to the recogniser's in one forward pass; after a word that isn't found none is."""
    en = F.col("file_id").startswith("ALL")
    words = M.word_rows(_t(spark, d, "intervals")).filter(~F.col("pause") & en).select("file_id", "idx", F.lit(0).alias("sub"), T.aligner_token_ja(F.col("label")).alias("token"), F.col("label").alias("word"), "s", "e")
    heard = _chunks(spark, d).filter(en).select("file_id", "chunk_no", F.posexplode("words").alias("pos", "w")).select("file_id", _place().alias("idx"), T.aligner_token_ja(F.col("w.word")).alias("token"), "w.s", "w.e")
    return L.aligner_times(words, heard, K, joins=1)


def pause_windows(spark: SparkSession, d: str) -> DataFrame:
    """Views among the events of each user and hour, by the streaming operator."""
    e = _t(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_type")
    return P.streaming_pause_counts(e, "user_id", "at", "event_type = 'view'").select("user_id", F.unix_micros("window_start").alias("start_us"), "n_pauses", "n")


def file_ids(spark: SparkSession, d: str) -> DataFrame:
    """File ids of paths as tools write them: folders, extensions and suffixes gone."""
    f = _t(spark, d, "asr_json").select("file_id").distinct()
    paths = F.array(F.concat(F.lit("/data/in/"), "file_id", F.lit(".TextGrid")), F.concat(F.lit("out\\"), "file_id", F.lit("_vad_classifier.csv")), F.concat("file_id", F.lit("_CLAUSES.txt")))
    return f.select("file_id", F.posexplode(paths).alias("form", "path")).select(T.file_stem(F.col("path")).alias("stem"), "form")


def correlation_p_values(spark: SparkSession, d: str) -> DataFrame:
    """p-values of the correlations between raw and refined measures, with their correlations."""
    c = IQ.measure_correlations(spark, d)
    return c.select("subset", "measure", "n", A.p_value("pearson_r", "n").alias("pearson_p"), A.p_value("spearman_rho", "n").alias("spearman_p"))


_VOWELISH = "lower(label[k + 1]) IN ('a', 'e', 'i', 'o', 'u')"
_FILLER_JA = ", ".join(f"'{f}'" for f in CL.FILLERS_JA)
_JA = "[ぁ-ヿ一-鿿]"


def _count_fillers(gap: str) -> str:
    return f"CAST(CASE WHEN {gap} < 0.4::DOUBLE THEN 0 ELSE least(floor(({gap} - 0.35::DOUBLE) / 0.55::DOUBLE) + 1, 3) END AS BIGINT)"


_EVENTS_SQL = """
ev AS (SELECT DISTINCT file_id, gap_index, island_index, candidate_start AS s, candidate_end AS e, CASE WHEN contains(file_id, 'ST1') THEN 'ST1' WHEN contains(file_id, 'ST2') THEN 'ST2' ELSE 'OTHER' END AS split FROM candidates),
au AS (SELECT file_id, max(list_max(list_filter(list_transform(words, lambda w: w."end"), lambda x: NOT isnan(x)))) AS seconds FROM asr_json WHERE file_id NOT LIKE 'VNM%' GROUP BY 1 HAVING max(list_max(list_filter(list_transform(words, lambda w: w."end"), lambda x: NOT isnan(x)))) IS NOT NULL)"""

SQL = {
    "filler_union": f"WITH {WORDS},\n{_COVER}, every AS (SELECT file_id, s, e FROM said UNION ALL SELECT file_id, s, e FROM pred),\n{_merge_sql('u', 'every', 'file_id', 0.02)} SELECT file_id, s, e FROM u",
    "skip_reasons": """SELECT skip_reason, CASE WHEN n_voiced_islands = 0 THEN 'no_voiced_island' WHEN vad_occupancy < 0.1::DOUBLE OR vad_occupancy > 0.95::DOUBLE THEN 'vad_occupancy_out_of_range' WHEN prob_filler IS NULL OR isnan(prob_filler) THEN 'feature_extraction_failed' ELSE '' END AS by_rule, count(*) AS n
FROM (SELECT DISTINCT file_id, gap_index, island_index, vad_occupancy, n_voiced_islands, prob_filler, skip_reason FROM candidates) GROUP BY 1, 2""",
    "phone_unit_words": f"""WITH {WORDS}, lt AS (SELECT *, unnest(range(length(label))) AS k FROM w WHERE NOT pause AND label <> '' AND e > s),
ph AS (SELECT DISTINCT file_id, CASE WHEN k = 0 THEN s ELSE s + (e - s) * k / length(label) END AS ps, CASE WHEN k + 1 = length(label) THEN e ELSE s + (e - s) * (k + 1) / length(label) END AS pe, {_VOWELISH} AS v, k FROM lt),
c2 AS (SELECT w.file_id, w.idx, w.units, count(ph.ps) AS n FROM w LEFT JOIN ph ON ph.file_id = w.file_id AND ph.v AND ph.ps >= w.s AND ph.pe <= w.e GROUP BY 1, 2, 3)
SELECT file_id, CAST(sum(CASE WHEN units > 0 THEN greatest(n, 1) ELSE 0 END) AS BIGINT) AS units, count(*) FILTER (units > 0) AS n_words FROM c2 GROUP BY 1""",
    "edge_gap_fillers": f"""WITH {_CHUNKS}, dx AS (SELECT file_id, chunk_no, any_value(duration) AS duration FROM asr_json GROUP BY 1, 2),
o AS (SELECT file_id, chunk_no, duration, w FROM cx JOIN dx USING (file_id, chunk_no) WHERE len(w) > 0 AND NOT isnan(duration)),
u AS (SELECT file_id, chunk_no, duration, unnest(range(len(w))) AS idx, unnest(w) AS x FROM o),
m AS (SELECT file_id, chunk_no, min(x.s) - 0.5::DOUBLE AS low, min(x.s) + any_value(duration) AS high, arg_min(x.s, idx) AS f, arg_max(x.e, idx) AS l FROM u GROUP BY 1, 2),
g AS (SELECT file_id, chunk_no, 'between' AS place, lead(x.s) OVER (PARTITION BY file_id, chunk_no ORDER BY idx) - x.e AS gap FROM u UNION ALL SELECT file_id, chunk_no, 'leading', f - low FROM m UNION ALL SELECT file_id, chunk_no, 'trailing', high - l FROM m),
n AS (SELECT file_id, chunk_no, place, {_count_fillers('gap')} AS n FROM g WHERE gap IS NOT NULL) SELECT file_id, chunk_no, place, CAST(sum(n) AS BIGINT) AS n FROM n WHERE n > 0 GROUP BY 1, 2, 3""",
    "pause_agreement_files": f"""WITH {WORDS},\n{_located('l15', 'p')},\n{_located('l02', 'p', 0.02)}, j AS (SELECT file_id, count(*) AS n, count(*) FILTER (l15.location = l02.location) AS a FROM l15 JOIN l02 USING (file_id, s, e) GROUP BY 1)
SELECT file_id, coalesce(n, 0) AS n_pauses, coalesce(a, 0) AS n_agree, coalesce(a / n, 0) AS accuracy FROM (SELECT DISTINCT file_id FROM asr_json) LEFT JOIN j USING (file_id)""",
    "caller_match_rates": """WITH m AS (SELECT DISTINCT * FROM swda_metadata), g AS (SELECT from_caller_dialect_area, count(*) FILTER (coalesce(from_caller_education = to_caller_education, false)) AS n_match, count(*) AS n FROM m GROUP BY 1)
SELECT from_caller_dialect_area, n_match, n - n_match AS n_mismatch, 100.0::DOUBLE * n_match / n AS pct_match, 100.0::DOUBLE * (n - n_match) / n AS pct_mismatch FROM g""",
    "event_matches": f"WITH {_EVENTS_SQL} SELECT count(*) AS n_events, count(au.file_id) AS n_matched, count(*) - count(au.file_id) AS n_unmatched, count(DISTINCT au.file_id) AS n_keys FROM ev LEFT JOIN au USING (file_id)",
    "event_features": f"""WITH {_EVENTS_SQL}, x AS (SELECT s, e, greatest(ceil(seconds * 100), 1) AS n FROM ev JOIN au USING (file_id)),
y AS (SELECT *, CAST(least(greatest(round_even(s * 100, 0), 0), n) AS BIGINT) AS a, CAST(least(greatest(round_even(e * 100, 0), 0), n) AS BIGINT) AS b FROM x WHERE s IS NOT NULL AND e IS NOT NULL AND NOT isnan(s) AND NOT isnan(e)),
z AS (SELECT CASE WHEN b - a < 10 THEN 'too short' ELSE '' END AS dropped FROM y UNION ALL SELECT 'no time' FROM x WHERE s IS NULL OR e IS NULL OR isnan(s) OR isnan(e))
SELECT dropped, count(*) AS n, CASE WHEN dropped = '' THEN 2 * count(*) END AS n_values FROM z GROUP BY 1""",
    "tree_lemmas": r"""WITH u AS (SELECT any_value(pos) AS pos, any_value(trees) AS trees FROM swda_utterance WHERE pos IS NOT NULL GROUP BY conversation_no, transcript_index),
a AS (SELECT 'pos' AS source, unnest(list_filter(list_transform(string_split_regex(trim(pos), '\s+'), lambda x: string_split(x, '/')), lambda p: len(p) = 2)) AS p FROM u),
b AS (SELECT 'tree' AS source, unnest(list_transform(regexp_extract_all(array_to_string(trees, ' '), '\(([^\s()]+) ([^\s()]+)\)'), lambda x: list_reverse(string_split(regexp_replace(x, '[()]', '', 'g'), ' ')))) AS p FROM u),
c AS (SELECT source, p[1] AS word, p[2] AS tag FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT source, CASE WHEN left(tag, 1) IN ('V', 'N') AND length(word) > 4 THEN regexp_replace(lower(word), '(ing|ed|s)$', '') ELSE lower(word) END AS lemma, count(*) AS n FROM c GROUP BY 1, 2""",
    "clause_heads_ja": f"""WITH {_CHUNKS}, t AS (SELECT file_id, chunk_no AS sent, CAST(unnest(range(len(w))) AS INTEGER) AS i, unnest(w).word AS text FROM cx WHERE file_id NOT LIKE 'ALL%'),
v AS (SELECT *, regexp_matches(text, '(ました|ます)$') AS verb FROM t), r AS (SELECT *, max(CASE WHEN verb THEN i END) OVER (PARTITION BY file_id, sent) AS root, min(CASE WHEN verb THEN i END) OVER (PARTITION BY file_id, sent ORDER BY i DESC) AS nxt FROM v),
k AS (SELECT file_id, sent, coalesce(nxt, root) AS h, count(*) FILTER (text NOT IN ({_FILLER_JA})) AS n FROM r WHERE NOT verb AND root IS NOT NULL GROUP BY 1, 2, 3)
SELECT r.file_id, r.sent, r.i, CASE WHEN r.i = root THEN 'IND' ELSE 'SUB_ADVCL' END AS clause_type FROM r LEFT JOIN k ON k.file_id = r.file_id AND k.sent = r.sent AND k.h = r.i WHERE verb AND (r.i = root OR coalesce(k.n, 0) > 0)""",
    "clause_drops_ja": f"""WITH {WORDS}, j AS (SELECT *, regexp_matches(label, 'ました|ます|です') AS pred, length(label) AS n FROM c WHERE regexp_matches(label, '{_JA}'))
SELECT file_id, idx, NOT (n < 3 OR (n = 3 AND NOT pred) OR regexp_matches(label, '^[をにがで]+$') OR regexp_matches(label, 'ＪＪＥ|お願いします') OR (NOT pred AND n < 10)) AS kept,
  CASE WHEN n > 60 THEN regexp_replace(left(label, 60), '\\s\\S*$', '') ELSE label END AS text FROM j""",
    "clause_recovery": rf"""WITH {WORDS}, a AS (SELECT file_id, idx, label, len(string_split(trim(regexp_replace(label, '[\s　]+', ' ', 'g')), ' ')) AS n, regexp_matches(label, 'ed( |$)') AS verb FROM c WHERE NOT regexp_matches(label, '{_JA}')),
b AS (SELECT *, CASE WHEN n >= 4 THEN 'independent' WHEN (verb AND n >= 3) OR n > 5 THEN 'parataxis' ELSE 'fragment' END AS kind FROM a),
g AS (SELECT *, greatest(sum(CASE WHEN kind <> 'fragment' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 1) AS g FROM b)
SELECT file_id, min(idx) AS idx, coalesce(arg_min(CASE WHEN kind <> 'fragment' THEN kind END, CASE WHEN kind <> 'fragment' THEN idx END), 'fragment') AS clause_type, string_agg(label, ' ' ORDER BY idx) AS text FROM g GROUP BY file_id, g""",
    "clause_splits": f"""WITH {_CHUNKS}, t AS (SELECT file_id, chunk_no, len(string_split(trim(regexp_replace(transcript, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), ' ')) AS n FROM cx WHERE transcript IS NOT NULL AND file_id LIKE 'ALL%'),
p AS (SELECT file_id, chunk_no, CASE WHEN n > 20 THEN [10, n - 10] ELSE [n] END AS p FROM t) SELECT file_id, chunk_no, CAST(unnest(range(len(p))) AS INTEGER) AS part, CAST(unnest(p) AS INTEGER) AS n_words FROM p""",
    "original_words": f"""WITH {_CHUNKS}, o AS (SELECT file_id, chunk_no, CAST(unnest(range(len(w))) AS INTEGER) AS o, unnest(w).word AS word FROM cx),
k AS (SELECT file_id, chunk_no, o, row_number() OVER (PARTITION BY file_id, chunk_no ORDER BY o) - 1 AS p FROM o WHERE lower(word) NOT IN ('uh', 'um', 'er', 'hmm'))
SELECT file_id, chunk_no, CAST(p // 5 AS INTEGER) AS idx, min(o) AS "first", max(o) AS "last" FROM k GROUP BY 1, 2, 3""",
    "boundary_tolerance": f"""WITH {WORDS}, g AS (SELECT DISTINCT file_id, e AS g FROM c), a AS (SELECT DISTINCT file_id, s AS a FROM p),
n AS (SELECT g.file_id, g, a FROM g JOIN a ON g.file_id = a.file_id AND abs(g - a) <= 0.15::DOUBLE), b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY file_id, g ORDER BY abs(g - a), a) = 1),
m AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY file_id, a ORDER BY abs(g - a), g) = 1)
SELECT file_id, coalesce(x.n, 0) AS n_gold, coalesce(y.n, 0) AS n_auto, coalesce(z.n, 0) AS n_matched FROM (SELECT file_id, count(*) AS n FROM g GROUP BY 1) x FULL JOIN (SELECT file_id, count(*) AS n FROM a GROUP BY 1) y USING (file_id) LEFT JOIN (SELECT file_id, count(*) AS n FROM m GROUP BY 1) z USING (file_id)""",
    "kanji_readings": "SELECT word, reading FROM (SELECT DISTINCT form AS word, array_to_string(list_transform(string_split(form, ''), lambda c: chr(12449 + unicode(c) % 80)), '') || 'ー' AS reading FROM lexicon WHERE regexp_matches(form, '[一-鿿]') AND length(form) >= 2) WHERE length(reading) >= 3",
    "subtoken_alignment": f"WITH RECURSIVE {_MARKUP} SELECT conversation_no, caller, utterance_index, array_to_string(list_concat(list_concat([-100], flatten(list_transform(labels, lambda x: [x, x]))), [-100]), ' ') AS labels FROM sen",
    "sample_positions": f"""SELECT file_id, gap_index, island_index, CAST(least(greatest(round_even(candidate_start * 16000, 0), 0), 160000) AS BIGINT) AS "first", CAST(least(greatest(round_even(candidate_end * 16000, 0), 0), 160000) AS BIGINT) AS "last"
FROM (SELECT DISTINCT file_id, gap_index, island_index, candidate_start, candidate_end FROM candidates) WHERE NOT isnan(candidate_start) AND NOT isnan(candidate_end)""",
    "event_labels": "SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type IN ('view', 'click') THEN 0 END AS label, CASE WHEN value < 10 THEN 'train' WHEN value < 50 THEN 'valid' WHEN value < 90 THEN 'test' END AS split, count(*) AS n FROM events GROUP BY 1, 2",
    "aligner_map_back_en": f"""WITH RECURSIVE {WORDS}, {_CHUNKS},
ex AS (SELECT file_id, list({{'idx': idx, 'token': {_token_ja('label')}, 'word': label, 's': s, 'e': e}} ORDER BY idx) AS x FROM w WHERE NOT pause AND file_id LIKE 'ALL%' GROUP BY 1),
he AS (SELECT file_id, list(token ORDER BY idx) AS heard, list(s ORDER BY idx) AS hs, list(e ORDER BY idx) AS he FROM (
  SELECT file_id, chunk_no::BIGINT * 4294967296 + pos AS idx, x.s AS s, x.e AS e, {_token_ja('x.word')} AS token FROM (SELECT file_id, chunk_no, unnest(range(len(w))) AS pos, unnest(w) AS x FROM cx)) GROUP BY 1),
fw AS (
  SELECT file_id, x, coalesce(heard, CAST([] AS VARCHAR[])) AS heard, hs, he, 0 AS i, CAST(0 AS BIGINT) AS here, CAST(NULL AS BIGINT) AS a FROM ex LEFT JOIN he USING (file_id)
  UNION ALL SELECT file_id, x, heard, hs, he, i + 1, CASE WHEN t = '' THEN here WHEN q > 0 THEN here + q ELSE len(heard) END, CASE WHEN q > 0 THEN here + q END FROM (
    SELECT *, x[i + 1].token AS t, CASE WHEN here >= len(heard) OR x[i + 1].token = '' THEN 0 ELSE coalesce(list_position(list_slice(heard, here + 1, len(heard)), x[i + 1].token), 0) END AS q FROM fw WHERE i < len(x)))
SELECT file_id, x[i].idx AS idx, x[i].word AS word, round(coalesce(hs[a], x[i].s), 3) AS "start", round(coalesce(he[a], CASE WHEN x[i].e > x[i].s THEN x[i].e ELSE x[i].s + 0.001::DOUBLE END), 3) AS "end", CASE WHEN a IS NULL THEN 'rough' ELSE 'mfa' END AS source FROM fw WHERE i > 0""",
    "pause_windows": "SELECT user_id, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, count(*) FILTER (event_type = 'view') AS n_pauses, count(*) AS n FROM events GROUP BY 1, 2",
    "file_ids": "SELECT DISTINCT file_id AS stem, unnest([0, 1, 2]) AS form FROM asr_json",
}
QUERIES = {f.__name__: f for f in (
    filler_union, skip_reasons, phone_unit_words, edge_gap_fillers, pause_agreement_files, caller_match_rates, event_matches, event_features, tree_lemmas, clause_heads_ja, clause_drops_ja, clause_recovery, clause_splits,
    original_words, boundary_tolerance, kanji_readings, subtoken_alignment, sample_positions, event_labels, aligner_map_back_en, pause_windows, file_ids, correlation_p_values,
)}
