"""Speech transcripts into clean, ordered speaker turns.

Method. Speaker labels are split into a role word and a side; role words are matched to a roster of role words gathered
over all transcripts by phonetic block (Soundex), caller numbers to the roster of the conversation's metadata. Labels
that neither settles are assigned to the two sides by the assignment that agrees best with the other rows of their utterances. Lexical noise
(tape times, hesitations, sound notes, labels, markup signs) is stripped, and rows with a word left are put in
transcript order and gathered into turns.

A conversation may hold any share of the rows: turns are numbered inside blocks of transcript_index first, and only one
row per block is ordered along a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.session import small_table, written

# Role words of speaker labels.
ROLES = ("speaker", "spk", "caller")

#: A label at the start of a text: "A:", "B>", "A >>", "Speaker A:".
TEXT_LABEL = r"^\s*(?:(?i:speaker|spk|caller)[\s_\-]*)?[\[@(]?([ABab])[\])]?\s*(?::|>{1,2})"
#: Sound notes and times in brackets; a repair's bracket is followed by a space or holds a plus sign.
NOTES = r"<<[^<>]*>>|<[^<>]*>|\(\([^()]*\)\)|\([^()]*\)|\[[^\s\[\]+][^\[\]+]*\]|\*[^*]+\*"
TIMES = r"(?<!\b[Aa]t )(?<![\d:.])\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d+)?(?![\d:])"
#: uh, um, er, erm, hmm and the like, however long drawn.
HESITATIONS = r"(?i)(?<![\p{L}\p{N}'])(?:u+h+|u+h*m+|e+r+m*|e+h+|a+h+m*|h+m+|m{2,}|mh+m+)(?![\p{L}\p{N}']|-\p{L})"
MARKUP = r"\{[A-Z]\s|[{}\[\]+/#\x{266a}\x{266b}<>]|-->|--+|\.\.\.|(?<![\p{L}\p{N}])-(?![\p{L}\p{N}])"
_ROLE_AND_SIDE = r"^([a-z]*?)\s*([ab])$"
_BLOCK = 50_000


def _bare(text: Column) -> Column:
    """A text without label, notes, times, markup and hesitations."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), TEXT_LABEL, " ")
    for pattern in (NOTES, TIMES, MARKUP, HESITATIONS):
        t = F.regexp_replace(t, pattern, " ")
    return t


def clean_text(text: Column) -> Column:
    """The words of a text, with sentence punctuation, single spaces. Null gives ''."""
    t = F.regexp_replace(_bare(text), r"(?U)\s+(?=[,.?!;])", "")
    t = F.regexp_replace(t, r"(?U)(?:^|(?<=\s))[,.?!;:\-]+|(?<=,),+", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


#: Lower-case letters of neither hesitations nor side letters: one of them is a word's, where a text holds nothing that
#: may be a note (a bracket before a space opens a repair, and what follows a brace is upper case) and no role word.
_SURE = "[cdfgijklnopqstvwxyz]"
_MAYBE_NOT = r"[<(*]|\[\S|^\s*(?i:speaker|spk|caller)"


def has_word(text: Column) -> Column:
    """Whether clean_text leaves a letter or digit (what it does after _bare takes none). Texts that surely hold a word
    aren't stripped; a test compares both over whole tables."""
    return F.when(text.rlike(_SURE) & ~text.rlike(_MAYBE_NOT), True).otherwise(_bare(text).rlike(r"[\p{L}\p{N}]"))


def plain_label(label: Column) -> Column:
    """Label in lower case, full-width letters made plain, signs around it gone."""
    t = F.translate(F.lower(F.translate(label, "ＡＢａｂ", "ABab")), "_-", "  ")
    return F.trim(F.regexp_replace(t, r"(?U)[^\p{L}\p{N}\s]+", ""))


def label_side(label: Column, roles: tuple[str, ...] = ROLES) -> Column:
    """'A' or 'B' by the label's side letter, where its role word falls into a roster word's phonetic block (or is
    missing); else null."""
    plain = plain_label(label)
    role = F.regexp_extract(plain, _ROLE_AND_SIDE, 1)
    side = F.upper(F.regexp_extract(plain, _ROLE_AND_SIDE, 2))
    blocks = [F.soundex(F.lit(r)) for r in roles]
    return F.when((side != "") & ((role == "") | F.soundex(role).isin(*blocks)), side)


def learned_roles(rows: DataFrame, share: float = 0.001) -> tuple[str, ...]:
    """The roster of role words of all transcripts: ROLES, and words that stand apart before both side letters in at
    least `share` of the labels of this form. At most 2 / share words can be that frequent."""
    labels = rows.groupBy("caller").agg(F.count(F.lit(1)).alias("n"))  # many rows, few spellings
    plain, form = plain_label(F.col("caller")), r"^([a-z]{2,})\s+([ab])$"
    parts = labels.select(F.regexp_extract(plain, form, 1).alias("role"), F.regexp_extract(plain, form, 2).alias("side"), "n").filter("role <> ''")
    of_side = lambda s: F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).alias(s)
    seen = parts.groupBy("role").agg(F.sum("n").alias("n"), of_side("a"), of_side("b"))
    total = seen.agg(F.sum("n")).first()[0] or 0
    found = small_table(seen.filter("a > 0 and b > 0").filter(F.col("n") >= share * total).select("role"), int(2 / share))
    return tuple(dict.fromkeys([*ROLES, *sorted(r["role"] for r in found)]))


def known_numbers(roster: DataFrame) -> DataFrame:
    """Caller numbers of each conversation's metadata with their side (1: A, 2: B); numbers of both sides tell nothing."""
    sides = F.array(*[F.struct(F.col(c).cast("bigint").alias("number"), F.lit(k).alias("side")) for c, k in (("from_caller", 1), ("to_caller", 2))])
    each = roster.select(F.col("conversation_no").cast("bigint").alias("conversation_no"), F.explode(sides).alias("r")).select("conversation_no", "r.*").filter("number is not null")
    return each.groupBy("conversation_no", "number").agg(F.min("side").alias("by_number"), F.max("side").alias("_other")).filter("by_number = _other").drop("_other")


def _side(letter: Column) -> Column:
    return F.when(letter == "A", 1).when(letter == "B", 2)


def row_facts(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """One row per (conversation_no, transcript_index) with what it tells by itself: utterance_index,
    subutterance_index, word (a delivery has a word left), two_texts (deliveries differ in text), text_hash, sure (side
    by label, by the label's number in the roster, or by a label in the text) and label (hash of the plain label).

    Texts and labels end here: everything later is numbers and flags, which aggregate in hash tables. The result is
    written to the shared folder, as the steps after it read it several times."""
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = plain_label(F.col("caller"))
    told = rows.select(
        F.col("conversation_no").cast("bigint").alias("conversation_no"), "transcript_index", "utterance_index", "subutterance_index", has_word(text).alias("word"), F.xxhash64(text).alias("h"),
        _side(label_side(F.col("caller"), learned_roles(rows))).alias("by_label"), plain.try_cast("bigint").alias("number"), F.when(plain != "", F.xxhash64(plain)).alias("label"), _side(F.upper(F.regexp_extract(text, TEXT_LABEL, 1))).alias("by_text"),
    )
    one = told.groupBy("conversation_no", "transcript_index").agg(
        *[F.max(c).alias(c) for c in ("utterance_index", "subutterance_index", "word", "number", "label")], *[F.min(c).alias(c) for c in ("by_label", "by_text")], F.min("h").alias("text_hash"), F.max("h").alias("_h"))
    one = one.join(known_numbers(roster), ["conversation_no", "number"], "left")
    return written(one.select(
        "conversation_no", "transcript_index", "utterance_index", "subutterance_index", "word", (F.col("text_hash") != F.col("_h")).alias("two_texts"), "text_hash", F.coalesce("by_label", "by_number", "by_text").alias("sure"), "label"), "row-facts")


def resolve_speakers(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """One row per (conversation_no, transcript_index) with its speaker.

    rows: swda_utterance. roster: swda_metadata (repeated and missing conversations allowed). Returns conversation_no
    (BIGINT), transcript_index, utterance_index, subutterance_index, word, two_texts, text_hash (see row_facts), speaker
    ('A', 'B', or null where nothing tells).
    Order of evidence: the caller's label; its number in the roster; a label in the text; the nearest row of the same
    utterance; the assignment of the conversation's unknown labels. Null text counts as ''. Empty tables: empty result.

    Rows that tell their speaker by themselves pass straight through; only utterances with an open row are ordered.
    """
    one = row_facts(rows, roster)
    utterance = ["conversation_no", "utterance_index"]
    with_open = one.filter("conversation_no is not null and utterance_index is not null").groupBy(*utterance).agg(F.count_if(F.col("sure").isNull()).alias("_open"), F.count("sure").alias("_sure")).filter("_open > 0 and _sure > 0")
    # The nearest row of the same utterance whose speaker is known, before and after; of equally near ones the one before.
    at = F.when(F.col("sure").isNotNull(), F.struct("transcript_index", "sure"))
    seen_so_far = lambda order: F.last(at, True).over(Window.partitionBy(*utterance).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    asked = one.join(with_open.select(*utterance), utterance, "left_semi").withColumns({"_b": seen_so_far(F.asc("transcript_index")), "_a": seen_so_far(F.desc("transcript_index"))}).filter("sure is null")
    far = lambda c: F.abs(F.col(f"{c}.transcript_index") - F.col("transcript_index"))
    near = F.when(F.col("_a").isNull() | (far("_b") <= far("_a")), F.col("_b.sure")).otherwise(F.col("_a.sure"))
    alone = one.filter("sure is null").join(with_open.select(*utterance), utterance, "left_anti").withColumn("by_utterance", F.lit(None).cast("int"))
    still_open = asked.withColumn("by_utterance", near).drop("_a", "_b").unionByName(alone)
    # Labels of a conversation that nothing settles row by row: the assignment to sides with the most agreement.
    # Labels without a margin take the side that neither a row nor another label has; with both sides taken they stay open.
    seen = still_open.filter("label is not null").groupBy("conversation_no", "label").agg((F.count_if(F.col("by_utterance") == 1) - F.count_if(F.col("by_utterance") == 2)).alias("margin"), F.min("transcript_index").alias("first"))
    sides = one.join(seen.select("conversation_no").distinct(), "conversation_no", "left_semi").groupBy("conversation_no").agg(F.count_if(F.col("sure") == 1).alias("a"), F.count_if(F.col("sure") == 2).alias("b"))
    of, every = Window.partitionBy("conversation_no").orderBy(F.desc("margin"), "first", "label"), Window.partitionBy("conversation_no")
    has_a, has_b = (F.max((F.col(c) > 0) | side).over(every) for c, side in (("a", F.col("margin") > 0), ("b", F.col("margin") < 0)))
    first_takes_a = F.when(F.row_number().over(of) == 1, 1).otherwise(2)
    free = F.when(has_a & ~has_b, 2).when(has_b & ~has_a, 1).when(~has_a & ~has_b, first_takes_a)
    two_open = F.count(F.lit(1)).over(every) == 2
    assigned = seen.join(sides, "conversation_no", "left").select("conversation_no", "label", F.when(two_open, first_takes_a).when(F.col("margin") > 0, 1).when(F.col("margin") < 0, 2).otherwise(free).alias("by_assignment"))
    told = still_open.join(assigned, ["conversation_no", "label"], "left").withColumn("side", F.coalesce("by_assignment", "by_utterance"))
    columns = ["conversation_no", "transcript_index", "utterance_index", "subutterance_index", "word", "two_texts", "text_hash"]
    every_row = one.filter("sure is not null").select(*columns, F.col("sure").alias("side")).unionByName(told.select(*columns, "side"))
    return every_row.select(*columns, F.when(F.col("side") == 1, "A").when(F.col("side") == 2, "B").alias("speaker"))


def row_texts(rows: DataFrame) -> DataFrame:
    """The text of each (conversation_no BIGINT, transcript_index); of several the greatest, null counts as ''."""
    return rows.groupBy(F.col("conversation_no").cast("bigint").alias("conversation_no"), "transcript_index").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))


def speaker_turns(spoken: DataFrame, block: int = _BLOCK) -> DataFrame:
    """Turns: conversation_no, turn_no, speaker, first_index, last_index.

    spoken: conversation_no, transcript_index (unique in it), speaker. Rows without a speaker, conversation or index are
    left out.
    """
    rows = spoken.filter("speaker is not null and transcript_index is not null and conversation_no is not null").select("conversation_no", F.expr(f"transcript_index div {block}").alias("_k"), "transcript_index", "speaker")
    cell = Window.partitionBy("conversation_no", "_k").orderBy("transcript_index")
    changed = rows.withColumn("_new", (F.coalesce(F.lag("speaker").over(cell), F.col("speaker")) != F.col("speaker")).cast("int")).withColumn("_n", F.sum("_new").over(cell.rowsBetween(Window.unboundedPreceding, 0)))
    parts = changed.groupBy("conversation_no", "_k", "_n", "speaker").agg(F.min("transcript_index").alias("first_index"), F.max("transcript_index").alias("last_index"))
    ends = parts.groupBy("conversation_no", "_k").agg(F.min_by("speaker", "_n").alias("_first"), F.max_by("speaker", "_n").alias("_last"), F.max("_n").alias("_changes"))
    order = Window.partitionBy("conversation_no").orderBy("_k")
    ends = ends.withColumn("_opens", (~F.coalesce(F.lag("_last").over(order), F.lit("")).eqNullSafe(F.col("_first"))).cast("int"))
    ends = ends.select("conversation_no", "_k", (F.sum(F.col("_opens") + F.col("_changes")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_changes")).alias("_base"))
    return (
        parts.join(ends, ["conversation_no", "_k"]).withColumn("turn_no", (F.col("_base") + F.col("_n")).cast("int"))
        .groupBy("conversation_no", "turn_no", "speaker").agg(F.min("first_index").alias("first_index"), F.max("last_index").alias("last_index"))
    )


def clean_turns(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """speaker_turns of the rows of swda_utterance that have a word left."""
    return speaker_turns(resolve_speakers(rows, roster).filter("word"))
