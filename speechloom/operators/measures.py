"""Fluency measures per recording from interval tiers: pauses, clauses, units, refinement by filler islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.functions import text as T
from speechloom.operators import intervals as I

MIN_PAUSE = 0.25
MEASURES = ("AR", "SR", "MLR", "MCPR", "ECPR", "PR", "MCPD", "ECPD", "MPD")
# Names of the word, phone and clause tiers, in order of preference.
WORD_TIERS = ("words", "word", "Words", "Word")
WORD_TIERS_JA = (*WORD_TIERS, "単語", "transcription")
PHONE_TIERS = ("phones", "phone", "Phone", "Phones")
CLAUSE_TIERS = ("clauses", "clause", "Clauses", "Clause")


_COLUMNS = ("file_id", "tier", "tier_idx", "idx", "xmin", "xmax", "label")


def one_delivery(intervals: DataFrame) -> DataFrame:
    """Interval rows once each; repeated deliveries agree in all columns."""
    return intervals.select(*_COLUMNS).distinct()


def pick_tier(intervals: DataFrame, names: tuple[str, ...], else_first: bool = False) -> DataFrame:
    """Rows of each file's tier by the first of names it has; else_first: of its first tier where it has none.

    The choice is made on the files' tiers, one row each once combined on the map side; rows then join it, and those of
    other tiers leave the scan early where the names alone decide."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("tier")).cast("bigint")
    order = F.shiftleft(F.when(rank > 0, rank).otherwise(len(names) + 1 if else_first else F.lit(None)).cast("bigint"), 32) + F.col("tier_idx")
    best = intervals.groupBy("file_id", "tier", "tier_idx").agg(F.min(order).alias("_o")).groupBy("file_id").agg(F.min_by(F.struct("tier", "tier_idx"), "_o").alias("_t"), F.min("_o").alias("_o")).filter("_o is not null")
    chosen = best.select("file_id", "_t.*")
    rows = intervals if else_first else intervals.filter(F.col("tier").isin(*names))
    return rows.select(*_COLUMNS).join(chosen, ["file_id", "tier", "tier_idx"]).select(*_COLUMNS).distinct()


def word_rows(intervals: DataFrame, names: tuple[str, ...] = WORD_TIERS_JA, pauses: tuple[str, ...] = T.PAUSE_EXTENDED) -> DataFrame:
    """Word tier as file_id, idx, s, e, label, pause, units.

    Units are syllables, or moras for labels with kana or kanji; pauses and filler markers have none."""
    label = T.strip(F.col("label"))
    japanese = label.rlike(r"[\x{3041}-\x{30ff}\x{4e00}-\x{9fff}]")
    pause = T.is_pause(F.col("label"), pauses)
    units = F.when(pause | T.is_filler_marker(F.col("label")), 0).when(japanese, T.moras(label)).otherwise(T.syllables(label))
    return pick_tier(intervals, names, else_first=True).select("file_id", "idx", F.col("xmin").alias("s"), F.col("xmax").alias("e"), label.alias("label"), pause.alias("pause"), units.cast("int").alias("units"))


def phone_units(words: DataFrame, phones: DataFrame) -> DataFrame:
    """words with units counted as vowels of the phones inside, at least one; pauses and fillers stay at none.
    words: file_id, idx, s, e, label, pause, units; phones: file_id, s, e, label."""
    counted = I.contained_count(words, phones, ["file_id"], T.is_vowel_phone(F.col("label")))
    return counted.withColumn("units", F.when(F.col("units") > 0, F.greatest(F.col("n"), F.lit(1))).otherwise(0)).drop("n")


def clause_rows(intervals: DataFrame) -> DataFrame:
    """Non-blank clauses: file_id, idx, s, e, label."""
    t = pick_tier(intervals, CLAUSE_TIERS).filter(T.strip(F.col("label")) != "")
    return t.select("file_id", "idx", F.col("xmin").alias("s"), F.col("xmax").alias("e"), "label")


def long_pauses(words: DataFrame, min_pause: float = MIN_PAUSE) -> DataFrame:
    return words.filter(F.col("pause") & (F.col("e") - F.col("s") >= min_pause)).select("file_id", "s", "e")


def predicted_islands(candidates: DataFrame) -> DataFrame:
    """Candidates taken for fillers, with usable times: file_id, s, e."""
    good = (F.col("pred_filler") == 1) & ~F.isnan("candidate_start") & ~F.isnan("candidate_end") & (F.col("candidate_end") > F.col("candidate_start"))
    return candidates.filter(good).select("file_id", F.col("candidate_start").alias("s"), F.col("candidate_end").alias("e")).distinct()


def refine_pauses(pauses: DataFrame, islands: DataFrame, min_pause: float = MIN_PAUSE, merge_gap: float = 0.03) -> DataFrame:
    """I.subtract of islands, which are merged first: file_id, s, e, p_s, p_e, n_islands."""
    return I.subtract(pauses, I.merge(islands, ["file_id"], merge_gap), ["file_id"], min_pause, merge_gap)


def _mean(total: Column, n: Column) -> Column:
    return T.ratio(total, n)


def fluency_measures(words: DataFrame, clauses: DataFrame, pauses: DataFrame | None = None, min_pause: float = MIN_PAUSE) -> DataFrame:
    """The nine measures and their counts per file.

    words: word_rows. clauses: clause_rows. pauses: refined pauses, if they differ from the long pauses of words; runs
    (MLR) always break at the word tier's own pauses. Ratios with an empty denominator are 0. Results aren't rounded.
    """
    keys = ["file_id"]
    p = (long_pauses(words, min_pause) if pauses is None else pauses.select("file_id", "s", "e"))
    d = F.col("e") - F.col("s")
    time = lambda c: F.coalesce(F.sum(I.exact(c)).cast("double"), F.lit(0.0))
    located = I.classify(p, clauses, keys, "idx").groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_pauses"), time(d).alias("_dur"),
        F.count_if(F.col("location") == "mid").alias("n_mid"), time(F.when(F.col("location") == "mid", d)).alias("_mid"),
        F.count_if(F.col("location") == "end").alias("n_end"), time(F.when(F.col("location") == "end", d)).alias("_end"),
    )
    broken = I.along(words.withColumn("_b", (F.col("pause") & (d >= min_pause)).cast("bigint")), keys, I.row_block("idx"), ["idx"], _n=("sum", "_b"))
    runs = broken.withColumn("run", F.col("_n") + F.col("_b")).groupBy("file_id", "run").agg(
        F.sum("units").alias("units"), F.min_by("s", "idx").alias("_s"), F.min("idx").alias("_i"), F.max_by("e", "idx").alias("_e"), F.max("idx").alias("_j"))
    per = runs.groupBy("file_id").agg(F.sum("units").alias("units"), F.avg(F.when(F.col("units") > 0, F.col("units"))).alias("MLR"), F.min_by("_s", "_i").alias("_first"), F.max_by("_e", "_j").alias("_last"))
    n_clauses = clauses.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_clauses"))
    f = per.join(located, "file_id", "left").join(n_clauses, "file_id", "left").fillna(0, ["n_pauses", "_dur", "n_mid", "_mid", "n_end", "_end", "n_clauses"])
    f = f.withColumn("total_duration", F.col("_last") - F.col("_first")).withColumn("phonation_time", F.col("total_duration") - F.col("_dur"))
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return f.select(
        "file_id", T.ratio(F.col("units"), positive("phonation_time")).alias("AR"), T.ratio(F.col("units"), positive("total_duration")).alias("SR"), F.coalesce("MLR", F.lit(0.0)).alias("MLR"),
        T.ratio(F.col("n_mid"), positive("units")).alias("MCPR"), T.ratio(F.col("n_end"), positive("units")).alias("ECPR"), T.ratio(F.col("n_pauses"), positive("units")).alias("PR"),
        _mean(F.col("_mid"), F.col("n_mid")).alias("MCPD"), _mean(F.col("_end"), F.col("n_end")).alias("ECPD"), _mean(F.col("_dur"), F.col("n_pauses")).alias("MPD"),
        "units", "total_duration", "phonation_time", "n_pauses", F.col("n_mid").alias("n_mid_clause_pauses"), F.col("n_end").alias("n_end_clause_pauses"), "n_clauses",
    )


def refinement_stats(pauses: DataFrame, refined: DataFrame) -> DataFrame:
    """Per file: clf_pause_candidates, clf_pauses_split, clf_refined_pause_count. pauses: file_id, s, e; refined:
    refine_pauses."""
    before = pauses.groupBy("file_id").agg(F.count(F.lit(1)).alias("clf_pause_candidates"))
    after = refined.groupBy("file_id").agg(F.count(F.lit(1)).alias("clf_refined_pause_count"), F.count_if(F.col("n_islands") == 0).alias("_kept"))
    f = before.join(after, "file_id", "left").fillna(0)
    return f.select("file_id", "clf_pause_candidates", (F.col("clf_pause_candidates") - F.col("_kept")).alias("clf_pauses_split"), "clf_refined_pause_count")


def predict(prob: Column, threshold: float = 0.5) -> Column:
    """1 where a probability reaches the threshold; 0 below it and where there is none (null or NaN)."""
    return F.when(prob.isNull() | F.isnan(prob), 0).otherwise((prob >= threshold).cast("int"))


def skip_reason(occupancy: Column, n_islands: Column, prob: Column, low: float = 0.1, high: float = 0.95) -> Column:
    """Why a gap or island isn't scored; '' if it is."""
    return F.when(n_islands == 0, "no_voiced_island").when((occupancy < low) | (occupancy > high), "vad_occupancy_out_of_range").when(prob.isNull() | F.isnan(prob), "feature_extraction_failed").otherwise("")


def candidate_stats(candidates: DataFrame) -> DataFrame:
    """Per file: n_rows, n_scored, n_predicted, max_prob, mean_prob (NaN where nothing is scored). Probabilities are
    summed as decimals, so that the mean doesn't depend on the order of summing."""
    once = candidates.select("file_id", "gap_index", "island_index", "prob_filler", "pred_filler").distinct()
    p = F.when(F.col("prob_filler").isNotNull() & ~F.isnan("prob_filler"), F.col("prob_filler"))
    nan = F.lit(float("nan"))
    return once.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count(p).alias("n_scored"), F.count_if(F.col("pred_filler") == 1).alias("n_predicted"), F.coalesce(F.max(p), nan).alias("max_prob"), F.coalesce(F.try_divide(F.sum(I.exact(p)).cast("double"), F.count(p).cast("double")), nan).alias("mean_prob"))


def run_totals(stats: DataFrame) -> DataFrame:
    """One row over all files: n_files, totals, and means per file."""
    return stats.agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), F.sum("n_scored").alias("n_scored"), F.sum("n_predicted").alias("n_predicted"), F.avg("n_predicted").alias("mean_predicted"))
