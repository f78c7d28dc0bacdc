"""Whole conversations from message rows, ordered by utterance and subutterance, with those that are broken told apart.

Method. Rows without a conversation identifier are joined to conversations as connected components over reply links
(each row and the one before it in its file) and quote links (rows of one tree file), by alternating large-star and small-star joins;
a component takes the identifier one of its rows carries, else its least row number. Rows are then ordered by
(utterance_index, subutterance_index) and every conversation is validated by aggregation.

A conversation may hold any share of the rows: validation aggregates by position first, then by utterance, then by
conversation, so nothing but partial aggregates of a conversation meets in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from speechloom.llm.components import connected_components
from speechloom.llm.turns import clean_text, resolve_speakers, row_texts
from speechloom.session import written


def reply_links(rows: DataFrame, block: int = 50_000) -> DataFrame:
    """Links between each row of a file and the one before it: u, v (node ids). rows: node, swda_filename,
    transcript_index. Long files are linked inside blocks of transcript_index and between the blocks' ends."""
    rows = rows.filter("swda_filename is not null and transcript_index is not null").withColumn("_k", F.expr(f"transcript_index div {block}"))
    w = Window.partitionBy("swda_filename", "_k").orderBy("transcript_index", "node")
    inside = rows.withColumn("v", F.lag("node").over(w)).filter("v is not null").select(F.col("node").alias("u"), "v")
    ends = rows.groupBy("swda_filename", "_k").agg(F.min_by("node", F.struct("transcript_index", "node")).alias("first"), F.max_by("node", F.struct("transcript_index", "node")).alias("last"))
    between = ends.withColumn("v", F.lag("last").over(Window.partitionBy("swda_filename").orderBy("_k"))).filter("v is not null").select(F.col("first").alias("u"), "v")
    return inside.unionByName(between)


def quote_links(rows: DataFrame) -> DataFrame:
    """Links between the rows that quote one tree file (ptb_basename): each to the least of them."""
    quoted = rows.filter("ptb_basename is not null")
    least = quoted.groupBy("ptb_basename").agg(F.min("node").alias("v"))
    return quoted.join(least, "ptb_basename").filter("node <> v").select(F.col("node").alias("u"), "v")


def find_conversations(rows: DataFrame) -> DataFrame:
    """Conversation of each node by its links alone: node, component. rows: node, swda_filename, transcript_index,
    ptb_basename, one row per node. A row without links is a component of its own."""
    linked = connected_components(reply_links(rows).unionByName(quote_links(rows)))
    return rows.select("node").join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def with_identifiers(rows: DataFrame) -> DataFrame:
    """rows (swda_utterance) with conversation_no (BIGINT) filled in where it is missing.

    A component that holds an identifier gives it to its rows (of several the least); one without gets a negative number
    with 63 bits of its own. Only rows without identifier, and those their file or tree file links them to, are looked
    at; a table in which every row has one comes back as it is."""
    rows = rows.withColumn("conversation_no", F.col("conversation_no").cast("bigint"))
    lacking = rows.filter("conversation_no is null")
    if lacking.isEmpty():
        return rows
    # A row is known by its content, as its identifier isn't there: deliveries of one row are one node.
    node = F.xxhash64(*[c for c in ("swda_filename", "ptb_basename", "transcript_index", "utterance_index", "subutterance_index", "text") if c in rows.columns])
    links = written(lacking.select("swda_filename", "ptb_basename").distinct(), "lacking")
    files, trees = links.select("swda_filename").filter("swda_filename is not null").distinct(), links.select("ptb_basename").filter("ptb_basename is not null").distinct()
    every = rows.withColumn("node", node)
    near = every.join(files, "swda_filename", "left_semi").unionByName(every.join(trees, "ptb_basename", "left_semi")).unionByName(every.filter("conversation_no is null"))
    nodes = near.groupBy("node").agg(F.min("swda_filename").alias("swda_filename"), F.min("transcript_index").alias("transcript_index"), F.min("ptb_basename").alias("ptb_basename"), F.min("conversation_no").alias("given"))
    of = nodes.join(find_conversations(nodes.drop("given")), "node")
    named = of.groupBy("component").agg(F.min("given").alias("given"))
    named = named.select("component", F.coalesce(F.col("given"), F.col("component").bitwiseOR(F.lit(-(2**63)))).alias("found"))
    found = of.filter("given is null").join(named, "component").select("node", "found")
    filled = lacking.withColumn("node", node).join(found, "node").withColumn("conversation_no", F.col("found")).select(*rows.columns)
    return rows.filter("conversation_no is not null").unionByName(filled)


def validate(resolved: DataFrame) -> DataFrame:
    """One row per conversation: conversation_no, n_rows, lacks_index, utterance_gap, subutterance_gap, clash,
    n_speaking (speakers with a word), broken.

    resolved: rows of resolve_speakers. lacks_index: a row has no utterance_index or subutterance_index. The gaps: index
    values that are not exactly 1...maximum. clash: a position with two speakers or two texts.
    """
    said_by = lambda s: F.max(F.col("word") & (F.col("speaker") == s))
    side = F.when(F.col("speaker") == "A", 1).when(F.col("speaker") == "B", 2)
    position = resolved.groupBy("conversation_no", "utterance_index", "subutterance_index").agg(
        F.count(F.lit(1)).alias("n"), F.max("two_texts").alias("texts"), F.min("text_hash").alias("t0"), F.max("text_hash").alias("t1"), F.min(side).alias("s0"), F.max(side).alias("s1"), said_by("A").alias("a"), said_by("B").alias("b"),
    )
    lacks = F.col("utterance_index").isNull() | F.col("subutterance_index").isNull()
    clash = ~lacks & (F.col("texts") | (F.col("t0") != F.col("t1")) | (F.col("s0") != F.col("s1")))
    utterance = position.groupBy("conversation_no", "utterance_index").agg(
        F.sum("n").alias("n"), F.max(lacks).alias("lacks"), F.max(F.coalesce(clash, F.lit(False))).alias("clash"), F.max("a").alias("a"), F.max("b").alias("b"),
        F.count("subutterance_index").alias("subs"), F.min("subutterance_index").alias("lo"), F.max("subutterance_index").alias("hi"),
    )
    sub_gap = F.col("utterance_index").isNotNull() & ((F.col("lo") != 1) | (F.col("hi") != F.col("subs")))
    speaking = lambda c: F.coalesce(F.max(c), F.lit(False)).cast("int")
    whole = utterance.groupBy("conversation_no").agg(
        F.sum("n").alias("n_rows"), F.max("lacks").alias("lacks_index"), F.max(F.coalesce(sub_gap, F.lit(False))).alias("subutterance_gap"), F.max("clash").alias("clash"),
        F.count("utterance_index").alias("us"), F.min("utterance_index").alias("lo"), F.max("utterance_index").alias("hi"), (speaking("a") + speaking("b")).alias("n_speaking"),
    )
    whole = whole.withColumn("utterance_gap", F.coalesce((F.col("lo") != 1) | (F.col("hi") != F.col("us")), F.lit(False)))
    broken = F.col("lacks_index") | F.col("utterance_gap") | F.col("subutterance_gap") | F.col("clash") | (F.col("n_speaking") < 2)
    return whole.select("conversation_no", "n_rows", "lacks_index", "utterance_gap", "subutterance_gap", "clash", "n_speaking", broken.alias("broken"))


def rebuild_conversations(rows: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of resolve_speakers with identifier, verdicts of validate). Nulls in any column are allowed; empty tables
    give empty results; further columns are ignored."""
    resolved = resolve_speakers(with_identifiers(rows), roster)
    return resolved, validate(resolved)


def good_conversations(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """The rows of whole conversations in order: conversation_no (BIGINT), position (from 1), speaker, utterance_index,
    subutterance_index, text, clean_text. position counts along (utterance_index, subutterance_index)."""
    rows = with_identifiers(rows)
    resolved = written(resolve_speakers(rows, roster), "resolved")
    good = validate(resolved).filter("not broken").select("conversation_no")
    # A whole conversation has each position once, but for repeats of one text by one speaker, and no holes: rows before
    # an utterance are those of earlier ones.
    kept = resolved.join(good, "conversation_no", "left_semi").groupBy("conversation_no", "utterance_index", "subutterance_index").agg(F.min("speaker").alias("speaker"), F.min("transcript_index").alias("transcript_index"))
    kept = written(kept, "positions")
    sizes = kept.groupBy("conversation_no", "utterance_index").agg(F.count(F.lit(1)).alias("_n"))
    # Running sums inside blocks of utterances, and over one row per block.
    sizes = sizes.withColumn("_k", F.expr("utterance_index div 50000"))
    so_far = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)
    blocks = sizes.groupBy("conversation_no", "_k").agg(F.sum("_n").alias("_t"))
    blocks = blocks.select("conversation_no", "_k", (F.sum("_t").over(so_far("conversation_no", "_k")) - F.col("_t")).alias("_base"))
    before = F.col("_base") + F.sum("_n").over(so_far("conversation_no", "_k", "utterance_index")) - F.col("_n")
    placed = kept.join(sizes.join(blocks, ["conversation_no", "_k"]).withColumn("_before", before), ["conversation_no", "utterance_index"])
    return placed.join(row_texts(rows), ["conversation_no", "transcript_index"]).select(
        "conversation_no", (F.col("_before") + F.col("subutterance_index")).cast("int").alias("position"), "speaker", "utterance_index", "subutterance_index", "text", clean_text(F.col("text")).alias("clean_text"))
