"""Queries over the annotation tables: interval algebra, fluency measures, candidate statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.functions import text as T
from speechloom.operators import agreement as A
from speechloom.operators import intervals as I
from speechloom.operators import measures as M
from speechloom.session import written
from speechloom.sinks import writers as W
from speechloom.sources import textgrid as TG

K = ["file_id"]


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/intervals.parquet")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/candidates.parquet")


def _words(spark: SparkSession, d: str) -> DataFrame:
    return M.word_rows(_intervals(spark, d))


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d).filter(~F.col("pause"))


def _tiers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Words and clauses, written once, as measures read them several times."""
    return written(_words(spark, d), "words"), written(M.clause_rows(_intervals(spark, d)), "clauses")


def fluency_measures(spark: SparkSession, d: str) -> DataFrame:
    return M.fluency_measures(*_tiers(spark, d))


def _refined(words: DataFrame, clauses: DataFrame, candidates: DataFrame) -> DataFrame:
    return M.fluency_measures(words, clauses, written(M.refine_pauses(M.long_pauses(words), M.predicted_islands(candidates)), "refined"))


def fluency_refined(spark: SparkSession, d: str) -> DataFrame:
    """The measures with pauses cut by predicted fillers; runs keep the word tier's own pauses."""
    return _refined(*_tiers(spark, d), _candidates(spark, d))


def refinement_stats(spark: SparkSession, d: str) -> DataFrame:
    pauses = written(M.long_pauses(_words(spark, d)), "pauses")
    return M.refinement_stats(pauses, M.refine_pauses(pauses, M.predicted_islands(_candidates(spark, d))))


def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    return I.merge(_spoken(spark, d), K, 0.03)


def merge_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of candidate islands in hundredths of a second, ended where the last one ends."""
    c = _candidates(spark, d).filter("not isnan(candidate_start) and not isnan(candidate_end) and candidate_end > candidate_start")
    unit = lambda x: F.floor(F.col(x) * 100).cast("bigint")
    return I.merge_last_end(c.select("file_id", unit("candidate_start").alias("s"), unit("candidate_end").alias("e")).distinct(), K, 300, 100 * I.BLOCK)


def interval_gaps(spark: SparkSession, d: str) -> DataFrame:
    words = written(_words(spark, d), "words")
    return I.gaps(I.merge(words.filter(~F.col("pause")), K, 0.03), K, 0.12, 0.0, words.groupBy("file_id").agg(F.max("e").alias("duration")))


def gap_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of 0.12 to 1.2 s with their number along the recording; longer ones leave holes in the numbers."""
    words = written(_words(spark, d), "words")
    return I.numbered_gaps(I.merge(words.filter(~F.col("pause")), K, 0.03), K, 0.12, 1.2, words.groupBy("file_id").agg(F.max("e").alias("duration"))).select("file_id", F.col("gap_index").cast("int").alias("gap_index"), "s", "e")


def pause_location(spark: SparkSession, d: str) -> DataFrame:
    return I.classify(M.long_pauses(_words(spark, d)), M.clause_rows(_intervals(spark, d)), K, "idx")


def run_lengths(spark: SparkSession, d: str) -> DataFrame:
    words = _words(spark, d)
    return I.run_units(words, K, "idx", F.col("pause") & (F.col("e") - F.col("s") >= M.MIN_PAUSE), F.col("units")).select("file_id", "run", "units")


def pause_subtract(spark: SparkSession, d: str) -> DataFrame:
    return M.refine_pauses(M.long_pauses(_words(spark, d)), M.predicted_islands(_candidates(spark, d))).select("file_id", "s", "e", "p_s", "p_e")


def tier_patch(spark: SparkSession, d: str) -> DataFrame:
    words = _words(spark, d).select("file_id", "s", "e", "label")
    return I.patch(words, M.predicted_islands(_candidates(spark, d)), K, T.is_pause(F.col("label"), T.PAUSE_EXTENDED), "<filler_speech>")


def coalesce_labels(spark: SparkSession, d: str) -> DataFrame:
    """Word tier with pauses of any spelling as one blank, neighbours joined."""
    words = _words(spark, d).select("file_id", "s", "e", F.when(F.col("pause"), "").otherwise(F.col("label")).alias("label"))
    return I.coalesce_equal(words, K)


def _fillers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    words = _words(spark, d)
    said = words.filter(T.in_filler_lexicon(F.col("label"), T.FILLERS_PERMISSIVE) | F.lower("label").isin("uh", "um", "er", "hmm"))
    return written(I.merge(said, K, 0.05), "said"), written(I.merge(M.predicted_islands(_candidates(spark, d)), K, 0.02), "predicted")


def overlap_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per recording with spoken fillers: their time, predicted time, time in both, and how many are hit."""
    said, predicted = _fillers(spark, d)
    total = lambda df, n: df.groupBy(*K).agg(F.sum(I.exact(F.col("e") - F.col("s"))).cast("double").alias(n), F.count(F.lit(1)).alias(f"n_{n}"))
    return total(said, "said").join(total(predicted, "predicted"), K, "left").join(I.hits(said, predicted, K), K, "left").fillna(0)


def coverage_summary(spark: SparkSession, d: str) -> DataFrame:
    """Micro and macro recall and precision of predicted filler time by task; undefined ratios are NaN and left out of
    macro means."""
    per = overlap_coverage(spark, d).withColumn("task", T.task_ja(F.col("file_id")))
    per = per.withColumn("recall", T.safe_div(F.col("overlap"), F.col("said"))).withColumn("precision", T.safe_div(F.col("overlap"), F.col("predicted")))
    per = written(per, "coverage")
    sums = lambda c: F.sum(I.exact(F.col(c))).cast("double")
    micro = per.groupBy("task").agg(T.safe_div(sums("overlap"), sums("said")).alias("recall_micro"), T.safe_div(sums("overlap"), sums("predicted")).alias("precision_micro"))
    return micro.join(A.macro(per, ["task"], ["recall", "precision"]), "task")


def timeline(spark: SparkSession, d: str) -> DataFrame:
    """Candidate spans as a gapless tier from the first gap to the last of a recording."""
    c = _candidates(spark, d)
    bounds = c.groupBy("file_id").agg(F.min("gap_start").alias("low"), F.max("gap_end").alias("high"))
    spans = c.filter("not isnan(candidate_start) and not isnan(candidate_end)").select("file_id", F.col("candidate_start").alias("s"), F.col("candidate_end").alias("e"), F.col("pred_filler").cast("string").alias("label")).distinct()
    return I.fill_timeline(spans, K, bounds)


def span_blanking(spark: SparkSession, d: str) -> DataFrame:
    """Words outside the span of the recording's clauses become blank."""
    span = I.speech_span(M.clause_rows(_intervals(spark, d)), K, F.lit(False))
    return I.blank_outside(_words(spark, d).select("file_id", "idx", "s", "e", "label"), K, span)


def clause_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Word offset of each clause in its recording."""
    c = M.clause_rows(_intervals(spark, d)).select("file_id", "idx", F.size(F.split(T.normalize(F.col("label")), " ")).alias("n"))
    return I.offsets(c, K, "idx", F.col("n"))


def words_in_clauses(spark: SparkSession, d: str) -> DataFrame:
    """How many spoken words lie inside each clause."""
    c = M.clause_rows(_intervals(spark, d)).select("file_id", "idx", "s", "e")
    return I.contained_count(c, _words(spark, d), K, ~F.col("pause"))


def lead_gap_fillers(spark: SparkSession, d: str) -> DataFrame:
    """Filler tokens that fit between neighbouring words."""
    from speechloom.operators.align import lead_gap

    g = lead_gap(_spoken(spark, d), K).filter("gap is not null").select("file_id", "idx", T.gap_filler_count(F.col("gap")).alias("n"))
    return g.filter("n > 0")


def tier_choice(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the word tier of each file."""
    return M.pick_tier(_intervals(spark, d), M.WORD_TIERS_JA, True).groupBy("file_id", "tier").agg(F.count(F.lit(1)).alias("n"))


def units_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Syllables or moras of each label of the word tiers."""
    return _words(spark, d).groupBy("label").agg(F.min("units").alias("units"), F.count(F.lit(1)).alias("n"))


def pause_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Intervals that each pause predicate takes, and those of at least 0.25 s with a blank label."""
    i = M.one_delivery(_intervals(spark, d))
    n = lambda c, name: F.count_if(c).alias(name)
    return i.groupBy("tier").agg(n(T.is_pause(F.col("label")), "basic"), n(T.is_pause(F.col("label"), T.PAUSE_EXTENDED), "extended"), n(T.is_pause(F.col("label"), T.PAUSE_JA_BASELINE), "ja_baseline"), n((T.strip(F.col("label")) == "") & (F.col("xmax") - F.col("xmin") >= 0.25), "blank_long"), n(T.is_filler_marker(F.col("label")), "fillers"))


def candidate_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.candidate_stats(_candidates(spark, d))


def candidate_totals(spark: SparkSession, d: str) -> DataFrame:
    return M.run_totals(M.candidate_stats(_candidates(spark, d)))


def candidate_predict(spark: SparkSession, d: str) -> DataFrame:
    """Predictions at thresholds 0.3 and 0.7 by reason for skipping."""
    c = _candidates(spark, d).select("file_id", "gap_index", "island_index", "prob_filler", "skip_reason").distinct()
    return c.groupBy("skip_reason").agg(F.sum(M.predict(F.col("prob_filler"), 0.3)).alias("at_30"), F.sum(M.predict(F.col("prob_filler"), 0.7)).alias("at_70"))


def gap_occupancy(spark: SparkSession, d: str) -> DataFrame:
    """Per gap: time of its islands over its length."""
    c = _candidates(spark, d).filter("island_index >= 0").select("file_id", "gap_index", "island_index", "island_duration", "gap_duration").distinct()
    return c.groupBy("file_id", "gap_index").agg((F.sum(I.exact(F.when(~F.isnan("island_duration"), F.col("island_duration")))).cast("double") / F.max("gap_duration")).alias("occupancy"), F.count(F.lit(1)).alias("n_islands"))


def describe_measures(spark: SparkSession, d: str) -> DataFrame:
    return A.describe(fluency_measures(spark, d).withColumn("task", T.task_ja(F.col("file_id"))), ["task"], list(M.MEASURES))


def task_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Means of the measures overall and by task."""
    f = A.with_overall(fluency_measures(spark, d).withColumn("task", T.task_en(F.col("file_id"))), "task")
    return f.groupBy("task").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in M.MEASURES])


def measure_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Correlations of refined with raw measures, overall and by task (long table)."""
    words, clauses = _tiers(spark, d)
    auto = _refined(words, clauses, _candidates(spark, d)).select("file_id", *[F.col(m).alias(f"{m}_auto") for m in M.MEASURES])
    manual = M.fluency_measures(words, clauses).select("file_id", *[F.col(m).alias(f"{m}_manual") for m in M.MEASURES])
    return A.correlations(auto.join(manual, "file_id"), M.MEASURES, T.task_ja(F.col("file_id")), "refined").drop("pearson_p", "spearman_p")


def pause_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of pause locations found with tolerances of 0.15 s and 0.02 s, overall and by task."""
    p, c = written(M.long_pauses(_words(spark, d)), "pauses"), written(M.clause_rows(_intervals(spark, d)), "clauses")
    both = I.classify(p, c, K, "idx", 0.15).withColumnRenamed("location", "auto").join(I.classify(p, c, K, "idx", 0.02).withColumnRenamed("location", "gold"), ["file_id", "s", "e"])
    return A.location_scores(A.with_overall(both.withColumn("task", T.task_ja(F.col("file_id"))), "task"), ["task"])


def textgrid_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Interval rows written as long-form TextGrid text and read again."""
    return TG.intervals_of_text(W.textgrid_text(M.one_delivery(_intervals(spark, d)))).select("file_id", "tier_idx", "tier", "idx", "xmin", "xmax", "label")


def textgrid_short_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of short-form TextGrid text, read by built-in functions alone."""
    t = W.textgrid_short_text(M.one_delivery(_intervals(spark, d)))
    return t.select("file_id", F.explode(TG.short_words(F.col("value"), "words")).alias("w")).select("file_id", "w.*")


def textgrid_long_words(spark: SparkSession, d: str) -> DataFrame:
    t = W.textgrid_text(M.one_delivery(_intervals(spark, d)))
    return t.select("file_id", F.explode(TG.long_words(F.col("value"), "words")).alias("w")).select("file_id", "w.*")


def review_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Predicted fillers as a review tier, read back as candidates."""
    tiers = W.review_tiers(_candidates(spark, d), _words(spark, d))
    return W.candidates_from_review(tiers.filter("tier = 'review'")).select("file_id", "gap_index", "candidate_start", "candidate_end", "pred_filler", "skip_reason")


_STRIP = r"regexp_replace(label, '^[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+|[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+$', '', 'g')"
_BASIC = "'', 'sp', 'sil', 'spn', 'noise', '<sil>', '<sp>', '<spn>', '<p>', '<pause>', 'breath', '<breath>'"
_EXTENDED = _BASIC + ", 'pause', 'silb', 'sile', '#', '...'"
WORDS = rf"""
once AS (SELECT DISTINCT file_id, tier, tier_idx, idx, xmin, xmax, label FROM intervals),
l AS (SELECT file_id, idx, xmin AS s, xmax AS e, {_STRIP} AS label FROM once WHERE tier IN ('words', '単語')),
w AS (
  SELECT *, lower(label) IN ({_EXTENDED}) AS pause,
    CAST(CASE WHEN lower(label) IN ({_EXTENDED}, '<filler_speech>', '<filler>', 'filler_speech') THEN 0
      WHEN regexp_matches(label, '[ぁ-ヿ一-鿿]') THEN greatest(length(regexp_replace(label, '[\sぁぃぅぇぉゃゅょゎァィゥェォャュョヮっッー]', '', 'g')), 1)
      ELSE greatest(len(regexp_extract_all(lower(label), '[aeiouy]+')) - CASE WHEN len(regexp_extract_all(lower(label), '[aeiouy]+')) > 1 AND lower(label) LIKE '%e' THEN 1 ELSE 0 END, 1) END AS INTEGER) AS units
  FROM l),
c AS (SELECT file_id, idx, xmin AS s, xmax AS e, label FROM once WHERE tier = 'clauses' AND {_STRIP} <> ''),
p AS (SELECT DISTINCT file_id, s, e FROM w WHERE pause AND e - s >= 0.25::DOUBLE),
isl AS (SELECT DISTINCT file_id, candidate_start AS s, candidate_end AS e FROM candidates WHERE pred_filler = 1 AND NOT isnan(candidate_start) AND NOT isnan(candidate_end) AND candidate_end > candidate_start)"""


def _merge_sql(name: str, src: str, keys: str, gap: float) -> str:
    w = f"PARTITION BY {keys} ORDER BY s, e"
    return f"""{name}_1 AS (SELECT {keys}, s, e, max(e) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {src} WHERE e > s),
{name}_2 AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + {gap}::DOUBLE THEN 1 ELSE 0 END) OVER ({w} ROWS UNBOUNDED PRECEDING) AS g FROM {name}_1),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {name}_2 GROUP BY {keys}, g)"""


def _located(name: str, pauses: str, tolerance: float = 0.15) -> str:
    return f"""{name} AS (
  SELECT q.file_id, q.s, q.e, coalesce(arg_min(CASE WHEN abs(q.s - c.e) < {tolerance}::DOUBLE THEN 'end' ELSE 'mid' END, c.idx), 'end') AS location
  FROM {pauses} q LEFT JOIN c ON q.file_id = c.file_id AND (abs(q.s - c.e) < {tolerance}::DOUBLE OR (c.s < (q.s + q.e) / 2 AND (q.s + q.e) / 2 < c.e))
  GROUP BY q.file_id, q.s, q.e)"""


_SUBTRACT = ",\n".join([
    _merge_sql("im", "isl", "file_id", 0.03),
    "cut AS (SELECT p.file_id, p.s AS p_s, p.e AS p_e, greatest(p.s, im.s) AS s, least(p.e, im.e) AS e FROM p JOIN im ON p.file_id = im.file_id AND im.s < p.e AND im.e > p.s)",
    _merge_sql("cm", "cut", "file_id, p_s, p_e", 0.03),
    """ordered AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY file_id, p_s, p_e ORDER BY s), p_s) AS f, lead(s) OVER (PARTITION BY file_id, p_s, p_e ORDER BY s) IS NULL AS final FROM cm),
refined AS (
  SELECT file_id, f AS s, s AS e, p_s, p_e FROM ordered WHERE s - f >= 0.25::DOUBLE
  UNION ALL SELECT file_id, e, p_e, p_s, p_e FROM ordered WHERE final AND p_e - e >= 0.25::DOUBLE
  UNION ALL SELECT file_id, s, e, s, e FROM p WHERE NOT EXISTS (SELECT 1 FROM cut WHERE cut.file_id = p.file_id AND cut.p_s = p.s AND cut.p_e = p.e))""",
])
_MEASURES = """
runs AS (SELECT file_id, idx, s, e, units, sum(CASE WHEN pause AND e - s >= 0.25::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM w),
run AS (SELECT file_id, run, CAST(sum(units) AS BIGINT) AS units FROM runs GROUP BY file_id, run HAVING sum(units) > 0),
f AS (SELECT w.file_id, CAST(sum(units) AS BIGINT) AS u, arg_max(e, idx) - arg_min(s, idx) AS t FROM w GROUP BY w.file_id),
m AS (SELECT file_id, avg(units) AS MLR FROM run GROUP BY file_id),
n AS (
  SELECT file_id, count(*) AS n, sum(CAST(e - s AS DECIMAL(28,9)))::DOUBLE AS d, count(*) FILTER (location = 'mid') AS nm, coalesce(sum(CAST(e - s AS DECIMAL(28,9))) FILTER (location = 'mid'), 0)::DOUBLE AS dm,
    count(*) FILTER (location = 'end') AS ne, coalesce(sum(CAST(e - s AS DECIMAL(28,9))) FILTER (location = 'end'), 0)::DOUBLE AS de FROM loc GROUP BY file_id),
k AS (SELECT file_id, count(*) AS n_clauses FROM c GROUP BY file_id),
measures AS (
  SELECT f.file_id, coalesce(CASE WHEN t - coalesce(d, 0) > 0 THEN u / (t - coalesce(d, 0)) END, 0) AS AR, coalesce(CASE WHEN t > 0 THEN u / t END, 0) AS SR, coalesce(MLR, 0) AS MLR,
    coalesce(CASE WHEN u > 0 THEN nm / u END, 0) AS MCPR, coalesce(CASE WHEN u > 0 THEN ne / u END, 0) AS ECPR, coalesce(CASE WHEN u > 0 THEN n / u END, 0) AS PR,
    coalesce(CASE WHEN nm > 0 THEN dm / nm END, 0) AS MCPD, coalesce(CASE WHEN ne > 0 THEN de / ne END, 0) AS ECPD, coalesce(CASE WHEN n > 0 THEN d / n END, 0) AS MPD,
    u AS units, t AS total_duration, t - coalesce(d, 0) AS phonation_time, coalesce(n, 0) AS n_pauses, coalesce(nm, 0) AS n_mid_clause_pauses, coalesce(ne, 0) AS n_end_clause_pauses, coalesce(n_clauses, 0) AS n_clauses
  FROM f LEFT JOIN m USING (file_id) LEFT JOIN n USING (file_id) LEFT JOIN k USING (file_id))"""
_TASK_JA = "CASE WHEN contains(file_id, 'ST1') THEN 'ST1' WHEN contains(file_id, 'ST2') THEN 'ST2' ELSE 'OTHER' END"
_NINE = ["AR", "SR", "MLR", "MCPR", "ECPR", "PR", "MCPD", "ECPD", "MPD"]
_PLAIN = f"WITH {WORDS},\n{_located('loc', 'p')},\n{_MEASURES}"
_COVER = ",\n".join([
    "said_0 AS (SELECT file_id, s, e FROM w WHERE regexp_replace(translate(lower(label), '〜～ 　', 'ーー'), '^[.,!?！？。、・「」『』()（）\\[\\]【】]+|[.,!?！？。、・「」『』()（）\\[\\]【】]+$', '', 'g') IN ("
    + ", ".join(f"'{x}'" for x in (*T.FILLERS_PERMISSIVE, "uh", "um", "er", "hmm")) + "))",
    _merge_sql("said", "said_0", "file_id", 0.05), _merge_sql("pred", "isl", "file_id", 0.02),
    """hits AS (SELECT said.file_id, said.s, said.e, least(said.e, pred.e) - greatest(said.s, pred.s) AS o FROM said JOIN pred ON said.file_id = pred.file_id AND pred.s < said.e AND pred.e > said.s),
cov AS (
  SELECT a.file_id, said, n_said, coalesce(predicted, 0) AS predicted, coalesce(n_predicted, 0) AS n_predicted, coalesce(overlap, 0) AS overlap, coalesce(n_hit, 0) AS n_hit
  FROM (SELECT file_id, sum(CAST(e - s AS DECIMAL(28,9)))::DOUBLE AS said, count(*) AS n_said FROM said GROUP BY 1) a
  LEFT JOIN (SELECT file_id, sum(CAST(e - s AS DECIMAL(28,9)))::DOUBLE AS predicted, count(*) AS n_predicted FROM pred GROUP BY 1) b USING (file_id)
  LEFT JOIN (SELECT file_id, sum(CAST(o AS DECIMAL(28,9)))::DOUBLE AS overlap, count(DISTINCT (s, e)) AS n_hit FROM hits GROUP BY 1) h USING (file_id))""",
])
_GAPS = ",\n".join([
    "spoken AS (SELECT file_id, s, e FROM w WHERE NOT pause)", _merge_sql("cover", "spoken", "file_id", 0.03),
    """before AS (SELECT file_id, s, greatest(coalesce(max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS m FROM cover),
gaps AS (
  SELECT file_id, m AS s, s AS e FROM before WHERE s - m >= 0.12::DOUBLE
  UNION ALL SELECT a.file_id, coalesce(b.m, 0), a.d FROM (SELECT file_id, max(e) AS d FROM w GROUP BY 1) a LEFT JOIN (SELECT file_id, max(e) AS m FROM cover GROUP BY 1) b USING (file_id) WHERE a.d - coalesce(b.m, 0) >= 0.12::DOUBLE)""",
])
_KEPT_CANDIDATES = "(SELECT DISTINCT file_id, gap_index, island_index, gap_duration, island_duration, prob_filler, pred_filler, skip_reason FROM candidates)"
_STATS = f"""SELECT file_id, count(*) AS n_rows, count(*) FILTER (prob_filler IS NOT NULL AND NOT isnan(prob_filler)) AS n_scored, count(*) FILTER (pred_filler = 1) AS n_predicted,
  coalesce(max(prob_filler) FILTER (NOT isnan(prob_filler)), 'nan'::DOUBLE) AS max_prob, coalesce(sum(TRY_CAST(prob_filler AS DECIMAL(28,9))) FILTER (NOT isnan(prob_filler))::DOUBLE / nullif(count(*) FILTER (prob_filler IS NOT NULL AND NOT isnan(prob_filler)), 0), 'nan'::DOUBLE) AS mean_prob FROM {_KEPT_CANDIDATES} GROUP BY file_id"""

_N, _ALL = _MEASURES[_MEASURES.index("\nn AS (") + 1 : _MEASURES.index("\nk AS (")], _MEASURES[_MEASURES.index("\nmeasures AS (") + 1 :]
_REFINED = _N.replace("n AS (", "n2 AS (", 1).replace("FROM loc", "FROM loc2") + _ALL.replace("measures AS (", "refined_measures AS (", 1).replace("LEFT JOIN n USING", "LEFT JOIN n2 USING")
_CORRELATIONS = f"""
pairs AS ({" UNION ALL ".join(f"SELECT unnest(['Overall', {_TASK_JA.replace('file_id', 'r.file_id')}]) AS subset, '{m}' AS measure, CAST(r.{m} AS DOUBLE) AS a, CAST(o.{m} AS DOUBLE) AS b FROM refined_measures r JOIN measures o USING (file_id)" for m in _NINE)}),
ranked AS (SELECT *, rank() OVER (PARTITION BY subset, measure ORDER BY a) + (count(*) OVER (PARTITION BY subset, measure, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY subset, measure ORDER BY b) + (count(*) OVER (PARTITION BY subset, measure, b) - 1) / 2 AS rb,
  avg(a) OVER (PARTITION BY subset, measure) AS ca, avg(b) OVER (PARTITION BY subset, measure) AS cb, count(*) OVER (PARTITION BY subset, measure) AS n FROM pairs),
sums AS (SELECT subset, measure, any_value(n) AS n, avg(a) AS mean_auto, avg(b) AS mean_manual, corr(a, b) AS pearson_r, corr(ra, rb) AS spearman_rho, avg(a - b) AS bias, avg(abs(a - b)) AS mae,
  2 * sum(((a + b) / 2 - (ca + cb) / 2) ** 2) AS ssr, any_value(n * ((ca - (ca + cb) / 2) ** 2 + (cb - (ca + cb) / 2) ** 2)) AS ssc, sum((a - (ca + cb) / 2) ** 2 + (b - (ca + cb) / 2) ** 2) AS sst FROM ranked GROUP BY 1, 2),
icc AS (SELECT *, ssr / nullif(n - 1, 0) AS msr, ssc AS msc, (sst - ssr - ssc) / nullif(n - 1, 0) AS mse FROM sums)
SELECT 'refined' AS track, subset, measure, n, mean_auto, mean_manual, CASE WHEN n > 1 THEN pearson_r END AS pearson_r, CASE WHEN n > 1 THEN spearman_rho END AS spearman_rho,
  CASE WHEN abs(msr + mse + 2.0::DOUBLE / n * (msc - mse)) < 1e-15 THEN 1.0 ELSE (msr - mse) / (msr + mse + 2.0::DOUBLE / n * (msc - mse)) END AS icc_2_1, bias, mae FROM icc"""

SQL = {
    "measure_correlations": f"WITH {WORDS},\n{_SUBTRACT},\n{_located('loc', 'p')},\n{_located('loc2', 'refined')},\n{_MEASURES},\n{_REFINED},{_CORRELATIONS}",
    "fluency_measures": f"{_PLAIN} SELECT * FROM measures",
    "fluency_refined": f"WITH {WORDS},\n{_SUBTRACT},\n{_located('loc', 'refined')},\n{_MEASURES} SELECT * FROM measures",
    "refinement_stats": f"""WITH {WORDS},\n{_SUBTRACT} SELECT a.file_id, a.n AS clf_pause_candidates, coalesce(b.n, 0) AS clf_pauses_split, coalesce(r.n, 0) AS clf_refined_pause_count
FROM (SELECT file_id, count(*) AS n FROM p GROUP BY 1) a LEFT JOIN (SELECT file_id, count(DISTINCT (p_s, p_e)) AS n FROM cut GROUP BY 1) b USING (file_id) LEFT JOIN (SELECT file_id, count(*) AS n FROM refined GROUP BY 1) r USING (file_id)""",
    "interval_merge": f"WITH {WORDS},\nspoken AS (SELECT file_id, s, e FROM w WHERE NOT pause),\n{_merge_sql('x', 'spoken', 'file_id', 0.03)} SELECT file_id, s, e FROM x",
    "merge_runs": """WITH i AS (SELECT DISTINCT file_id, CAST(floor(candidate_start * 100) AS BIGINT) AS s, CAST(floor(candidate_end * 100) AS BIGINT) AS e FROM candidates WHERE NOT isnan(candidate_start) AND NOT isnan(candidate_end) AND candidate_end > candidate_start),
n AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY file_id ORDER BY s, e) <= 300 THEN 0 ELSE 1 END AS fresh FROM i), g AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM n)
SELECT file_id, min(s) AS s, arg_max(e, (s, e)) AS e FROM g GROUP BY file_id, g""",
    "interval_gaps": f"WITH {WORDS},\n{_GAPS} SELECT * FROM gaps",
    "gap_candidates": f"WITH {WORDS},\n{_GAPS} SELECT file_id, CAST(gap_index AS INTEGER) AS gap_index, s, e FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY s, e) - 1 AS gap_index FROM gaps) WHERE e - s <= 1.2::DOUBLE",
    "pause_location": f"WITH {WORDS},\n{_located('loc', 'p')} SELECT * FROM loc",
    "run_lengths": f"{_PLAIN} SELECT file_id, CAST(run AS BIGINT) AS run, units FROM run",
    "pause_subtract": f"WITH {WORDS},\n{_SUBTRACT} SELECT * FROM refined",
    "coalesce_labels": f"""WITH {WORDS}, t AS (SELECT file_id, s, e, CASE WHEN pause THEN '' ELSE label END AS label FROM w),
n AS (SELECT *, CASE WHEN abs(s - lag(e) OVER o) < 1e-6 AND label = lag(label) OVER o THEN 0 ELSE 1 END AS fresh FROM t WINDOW o AS (PARTITION BY file_id ORDER BY s, e)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT file_id, min(s) AS s, max(e) AS e, label FROM g GROUP BY file_id, g, label""",
    "tier_patch": f"""WITH {WORDS}, t AS (SELECT DISTINCT file_id, s, e, label, pause FROM w WHERE e > s), {_merge_sql('im', 'isl', 'file_id', 0.02)},
x AS (SELECT t.file_id, t.s AS p_s, t.e AS p_e, t.label, greatest(t.s, im.s) AS s, least(t.e, im.e) AS e FROM t JOIN im ON t.file_id = im.file_id AND im.s < t.e AND im.e > t.s WHERE t.pause),
y AS (SELECT *, coalesce(lag(e) OVER o, p_s) AS f, lead(s) OVER o IS NULL AS final FROM x WINDOW o AS (PARTITION BY file_id, p_s, p_e, label ORDER BY s)),
z AS (
  SELECT file_id, f AS s, s AS e, label FROM y WHERE s - f > 1e-4 UNION ALL SELECT file_id, s, e, '<filler_speech>' FROM y WHERE e - s > 1e-4 UNION ALL SELECT file_id, e, p_e, label FROM y WHERE final AND p_e - e > 1e-4
  UNION ALL SELECT file_id, s, e, label FROM t WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.file_id = t.file_id AND x.p_s = t.s AND x.p_e = t.e AND x.label = t.label)),
n AS (SELECT *, CASE WHEN abs(s - lag(e) OVER o) < 1e-6 AND label = lag(label) OVER o THEN 0 ELSE 1 END AS fresh FROM z WINDOW o AS (PARTITION BY file_id ORDER BY s, e)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT file_id, min(s) AS s, max(e) AS e, label FROM g GROUP BY file_id, g, label""",
    "overlap_coverage": f"WITH {WORDS},\n{_COVER} SELECT * FROM cov",
    "coverage_summary": f"""WITH {WORDS},\n{_COVER}, r AS (SELECT *, {_TASK_JA} AS task, CASE WHEN said > 0 THEN overlap / said END AS recall, CASE WHEN predicted > 0 THEN overlap / predicted END AS prec FROM cov)
SELECT task, coalesce(CASE WHEN sum(CAST(said AS DECIMAL(28,9))) > 0 THEN sum(CAST(overlap AS DECIMAL(28,9)))::DOUBLE / sum(CAST(said AS DECIMAL(28,9)))::DOUBLE END, 'nan'::DOUBLE) AS recall_micro, coalesce(CASE WHEN sum(CAST(predicted AS DECIMAL(28,9))) > 0 THEN sum(CAST(overlap AS DECIMAL(28,9)))::DOUBLE / sum(CAST(predicted AS DECIMAL(28,9)))::DOUBLE END, 'nan'::DOUBLE) AS precision_micro,
  count(*) AS n_files, avg(recall) AS macro_recall, avg(prec) AS macro_precision FROM r GROUP BY task""",
    "timeline": """WITH RECURSIVE b AS (SELECT file_id, min(gap_start) AS low, max(gap_end) AS high FROM candidates GROUP BY 1),
i AS (SELECT DISTINCT c.file_id, greatest(candidate_start, low) AS s, least(candidate_end, high) AS e, CAST(pred_filler AS VARCHAR) AS label, candidate_start AS s0, candidate_end AS e0 FROM candidates c JOIN b USING (file_id)
  WHERE NOT isnan(candidate_start) AND NOT isnan(candidate_end) AND least(candidate_end, high) > greatest(candidate_start, low)),
j AS (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s0, e0, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i),
k AS (SELECT file_id, greatest(s, coalesce(m, s)) AS s, e, label FROM j WHERE e > greatest(s, coalesce(m, s))),
h AS (SELECT file_id, coalesce(lag(e) OVER (PARTITION BY file_id ORDER BY s, e), low) AS s, s AS e, '' AS label FROM k JOIN b USING (file_id))
SELECT * FROM k UNION ALL SELECT * FROM h WHERE e > s UNION ALL SELECT file_id, coalesce(m, low), high, '' FROM b LEFT JOIN (SELECT file_id, max(e) AS m FROM k GROUP BY 1) USING (file_id) WHERE coalesce(m, low) < high""",
    "span_blanking": f"""WITH {WORDS}, sp AS (SELECT file_id, arg_min(s, (s, e)) AS a, arg_max(e, (s, e)) AS b FROM c GROUP BY 1)
SELECT w.file_id, idx, s, e, CASE WHEN s < a OR e > b THEN '' ELSE label END AS label FROM w LEFT JOIN sp USING (file_id)""",
    "clause_offsets": f"""WITH {WORDS}, n AS (SELECT file_id, idx, CAST(len(string_split(trim(regexp_replace(label, '[\\s　]+', ' ', 'g')), ' ')) AS INTEGER) AS n FROM c)
SELECT file_id, idx, n, CAST(coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM n""",
    "words_in_clauses": f"WITH {WORDS} SELECT c.file_id, c.idx, c.s, c.e, CAST(count(w.s) AS INTEGER) AS n FROM c LEFT JOIN w ON w.file_id = c.file_id AND NOT w.pause AND w.s >= c.s AND w.e <= c.e GROUP BY ALL",
    "lead_gap_fillers": f"""WITH {WORDS}, g AS (SELECT file_id, idx, lead(s) OVER (PARTITION BY file_id ORDER BY idx) - e AS gap FROM w WHERE NOT pause),
n AS (SELECT file_id, idx, CAST(CASE WHEN gap < 0.4::DOUBLE THEN 0 ELSE least(floor((gap - 0.35::DOUBLE) / 0.55::DOUBLE) + 1, 3) END AS INTEGER) AS n FROM g WHERE gap IS NOT NULL) SELECT * FROM n WHERE n > 0""",
    "tier_choice": f"WITH {WORDS} SELECT file_id, tier, count(*) AS n FROM once WHERE tier IN ('words', '単語') GROUP BY 1, 2",
    "units_by_label": f"WITH {WORDS} SELECT label, min(units) AS units, count(*) AS n FROM w GROUP BY 1",
    "pause_predicates": f"""WITH {WORDS} SELECT tier, count(*) FILTER (lower({_STRIP}) IN ({_BASIC})) AS basic, count(*) FILTER (lower({_STRIP}) IN ({_EXTENDED})) AS extended,
count(*) FILTER (lower({_STRIP}) IN ({_BASIC}, 'pause', 'silB', 'silE', '#', '...')) AS ja_baseline, count(*) FILTER ({_STRIP} = '' AND xmax - xmin >= 0.25::DOUBLE) AS blank_long, count(*) FILTER (lower({_STRIP}) IN ('<filler_speech>', '<filler>', 'filler_speech')) AS fillers FROM once GROUP BY 1""",
    "candidate_stats": _STATS,
    "candidate_totals": f"SELECT count(*) AS n_files, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n_scored) AS BIGINT) AS n_scored, CAST(sum(n_predicted) AS BIGINT) AS n_predicted, avg(n_predicted) AS mean_predicted FROM ({_STATS})",
    "candidate_predict": f"SELECT skip_reason, CAST(sum(CASE WHEN NOT isnan(prob_filler) AND prob_filler >= 0.3::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS at_30, CAST(sum(CASE WHEN NOT isnan(prob_filler) AND prob_filler >= 0.7::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS at_70 FROM {_KEPT_CANDIDATES} GROUP BY 1",
    "gap_occupancy": f"SELECT file_id, gap_index, sum(TRY_CAST(island_duration AS DECIMAL(28,9))) FILTER (NOT isnan(island_duration))::DOUBLE / max(gap_duration) AS occupancy, count(*) AS n_islands FROM {_KEPT_CANDIDATES} WHERE island_index >= 0 GROUP BY 1, 2",
    "describe_measures": f"{_PLAIN}, long AS (" + " UNION ALL ".join(f"SELECT {_TASK_JA} AS task, '{m}' AS measure, CAST({m} AS DOUBLE) AS v FROM measures" for m in _NINE) + """)
SELECT task, measure, count(v) AS count, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, max(v) AS max FROM long GROUP BY 1, 2""",
    "task_rollup": f"{_PLAIN}, t AS (SELECT *, CASE WHEN contains(file_id, 'ST1') THEN 'ST1' ELSE 'ST2' END AS task FROM measures) SELECT CASE WHEN grouping(task) = 1 THEN 'Overall' ELSE task END AS task, count(*) AS n, " + ", ".join(f"avg({m}) AS {m}" for m in _NINE) + " FROM t GROUP BY GROUPING SETS ((), (task))",
    "pause_agreement": f"""WITH {WORDS},\n{_located('l15', 'p')},\n{_located('l02', 'p', 0.02)},
j AS (SELECT unnest(['Overall', {_TASK_JA}]) AS task, l15.location AS a, l02.location AS g FROM l15 JOIN l02 USING (file_id, s, e)),
k AS (SELECT task, count(*) AS n, sum((a = 'mid' AND g = 'mid')::DOUBLE) AS mm, sum((a = 'end' AND g = 'end')::DOUBLE) AS ee, sum((a = 'mid')::DOUBLE) AS am, sum((g = 'mid')::DOUBLE) AS gm FROM j GROUP BY 1),
q AS (SELECT *, (am * gm + (n - am) * (n - gm)) / (n::DOUBLE * n) AS x FROM k)
SELECT task, n, CASE WHEN abs(1 - x) > 1e-12 THEN ((mm + ee) / n - x) / (1 - x) ELSE 1.0 END AS kappa, (mm + ee) / n AS accuracy,
  coalesce(mm / nullif(am, 0), 0) AS mcp_p, coalesce(mm / nullif(gm, 0), 0) AS mcp_r, coalesce(2 * mm / nullif(am + gm, 0), 0) AS mcp_f1,
  coalesce(ee / nullif(n - am, 0), 0) AS ecp_p, coalesce(ee / nullif(n - gm, 0), 0) AS ecp_r, coalesce(2 * ee / nullif(2 * n - am - gm, 0), 0) AS ecp_f1 FROM q""",
    "textgrid_roundtrip": "SELECT DISTINCT file_id, tier_idx, tier, idx, xmin, xmax, label FROM intervals",
    "textgrid_short_words": f"WITH {WORDS} SELECT file_id, xmin, xmax, lower(trim(label)) AS label FROM once WHERE tier = 'words' AND lower(trim(label)) NOT IN ('', 'sp', 'sil')",
    "textgrid_long_words": f"WITH {WORDS} SELECT file_id, xmin, xmax, lower(trim(label)) AS label FROM once WHERE tier = 'words' AND lower(trim(label)) NOT IN ('', 'sp', 'sil')",
    "review_roundtrip": f"""WITH isl AS (SELECT DISTINCT file_id, candidate_start AS s, candidate_end AS e FROM candidates WHERE pred_filler = 1 AND NOT isnan(candidate_start) AND NOT isnan(candidate_end) AND candidate_end > candidate_start), {_merge_sql('x', 'isl', 'file_id', 0.0)}
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY s) - 1 AS INTEGER) AS gap_index, s AS candidate_start, e AS candidate_end, 1 AS pred_filler, 'manual_review' AS skip_reason FROM x""",
}
QUERIES = {f.__name__: f for f in (
    fluency_measures, fluency_refined, refinement_stats, interval_merge, merge_runs, interval_gaps, gap_candidates, pause_location, run_lengths, pause_subtract, tier_patch, coalesce_labels,
    overlap_coverage, coverage_summary, timeline, span_blanking, clause_offsets, words_in_clauses, lead_gap_fillers, tier_choice, units_by_label, pause_predicates, candidate_stats, candidate_totals,
    candidate_predict, gap_occupancy, describe_measures, task_rollup, measure_correlations, pause_agreement, textgrid_roundtrip, textgrid_short_words, textgrid_long_words, review_roundtrip,
)}
