"""Schemas of the tables and files the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


INTERVALS = _struct(file_id=S, tier=S, tier_idx=I, idx=I, xmin=D, xmax=D, label=S)
WORD = _struct(word=S, start=D, end=D, source=S)
AUGMENTATION = _struct(mfa_word_count=I, filler_injected=I, filler_consumed=I, fallback_count=I, skipped_mfa_tokens=I, filler_injected_leading=I, filler_injected_trailing=I)
ASR_JSON = _struct(duration=D, transcript=S, n_words=I, words=T.ArrayType(WORD), filler_augmentation=AUGMENTATION)
ALIGNER_JSON = _struct(tiers=_struct(words=_struct(entries=T.ArrayType(T.ArrayType(S)))))
CANDIDATES = _struct(
    file_id=S, gap_index=I, island_index=I, gap_start=D, gap_end=D, gap_duration=D, vad_occupancy=D, n_voiced_islands=I, island_duration=D, candidate_start=D, candidate_end=D, prob_filler=D, pred_filler=I, skip_reason=S)
CAF = _struct(
    file=S, AR=D, SR=D, MLR=D, MCPR=D, ECPR=D, PR=D, MCPD=D, ECPD=D, MPD=D, total_syllables=I, total_duration=D, phonation_time=D, n_pauses=I, n_mid_clause_pauses=I, n_end_clause_pauses=I, n_clauses=I, error=S)
SWDA_COLUMNS = ["swda_filename", "ptb_basename", "conversation_no", "transcript_index", "act_tag", "caller", "utterance_index", "subutterance_index", "text", "pos", "trees", "ptb_treenumbers"]
SWDA_RAW = _struct(**{c: S for c in SWDA_COLUMNS})
SWDA_METADATA_RAW = _struct(
    conversation_no=S, talk_day=S, length=S, topic_description=S, prompt=S, from_caller=S, to_caller=S, from_caller_sex=S, to_caller_sex=S, from_caller_education=S, to_caller_education=S, from_caller_birth_year=S, to_caller_birth_year=S,
    from_caller_dialect_area=S, to_caller_dialect_area=S)
FILLER_EVENTS = _struct(podcast_filename=S, episode_split_subset=S, clip_split_subset=S, clip_start_inepisode=D, clip_end_inepisode=D, label_consolidated_vocab=S, clip_name=S, pfID=I)


def require(df, columns: T.StructType | list[str]) -> None:
    """Raise if df lacks any of the columns."""
    names = columns.fieldNames() if isinstance(columns, T.StructType) else columns
    if missing := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
