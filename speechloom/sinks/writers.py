"""Writers: TextGrid text, CSV per file and in one, summary JSON, reports, label pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom import schema as S
from speechloom.session import shuffle_partitions, written


def textgrid_text(intervals: DataFrame) -> DataFrame:
    """file_id, value: long-form TextGrid text of the interval rows (all schema.INTERVALS columns), quotes doubled.

    Tiers are put together from their rows, files from their tiers; a file is one value, as it is one file."""
    q = F.concat(F.lit('"'), F.replace("label", F.lit('"'), F.lit('""')), F.lit('"'))
    body = F.concat(F.lit("            xmin = "), F.col("xmin").cast("string"), F.lit(" \n            xmax = "), F.col("xmax").cast("string"), F.lit(" \n            text = "), q, F.lit(" \n"))
    tier = intervals.groupBy("file_id", "tier_idx", "tier").agg(F.sort_array(F.collect_list(F.struct("idx", body.alias("b")))).alias("rows"), F.min("xmin").alias("lo"), F.max("xmax").alias("hi"), F.count(F.lit(1)).alias("n"))
    line = F.array_join(F.transform("rows", lambda r, i: F.concat(F.lit("        intervals ["), (i + 1).cast("string"), F.lit("]:\n"), r["b"])), "")
    s = lambda c: F.col(c).cast("string")
    item = F.concat(F.lit('        class = "IntervalTier" \n        name = "'), F.replace("tier", F.lit('"'), F.lit('""')), F.lit('" \n        xmin = '), s("lo"), F.lit(" \n        xmax = "), s("hi"), F.lit(" \n        intervals: size = "), s("n"), F.lit(" \n"), line)
    file = tier.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("tier_idx", item.alias("t")))).alias("tiers"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    items = F.array_join(F.transform("tiers", lambda t, i: F.concat(F.lit("    item ["), (i + 1).cast("string"), F.lit("]:\n"), t["t"])), "")
    return file.select("file_id", F.concat(F.lit('File type = "ooTextFile"\nObject class = "TextGrid"\n\nxmin = '), s("lo"), F.lit(" \nxmax = "), s("hi"), F.lit(" \ntiers? <exists> \nsize = "), F.size("tiers").cast("string"), F.lit(" \nitem []:\n"), items).alias("value"))


def textgrid_short_text(intervals: DataFrame) -> DataFrame:
    """textgrid_text in the short form."""
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    s = lambda c: F.col(c).cast("string")
    tier = intervals.groupBy("file_id", "tier_idx", "tier").agg(F.sort_array(F.collect_list(F.struct("idx", F.concat_ws("\n", s("xmin"), s("xmax"), q("label")).alias("b")))).alias("rows"), F.min("xmin").alias("lo"), F.max("xmax").alias("hi"))
    item = F.concat_ws("\n", F.lit('"IntervalTier"'), q("tier"), s("lo"), s("hi"), F.size("rows").cast("string"), F.array_join(F.transform("rows", lambda r: r["b"]), "\n"))
    file = tier.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("tier_idx", item.alias("t")))).alias("tiers"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    head = F.concat_ws("\n", F.lit('File type = "ooTextFile"'), F.lit('Object class = "TextGrid"'), F.lit(""), s("lo"), s("hi"), F.lit("<exists>"), F.size("tiers").cast("string"))
    return file.select("file_id", F.concat_ws("\n", head, F.array_join(F.transform("tiers", lambda t: t["t"]), "\n"), F.lit("")).alias("value"))


def pause_tier(words: DataFrame, least: float = 0.25) -> DataFrame:
    """The tier of pauses beside a word tier: 'sp' on blank intervals of at least `least`, blank elsewhere."""
    return words.withColumn("tier", F.lit("pauses")).withColumn("tier_idx", F.col("tier_idx") + 1).withColumn("label", F.when((F.trim("label") == "") & (F.col("xmax") - F.col("xmin") >= least), "sp").otherwise(""))


def write_per_file(texts: DataFrame, path: str) -> None:
    """One text file per row of file_id, value, in a folder 'file_id=...' of any store that Spark writes to."""
    texts.select("file_id", "value").write.mode("overwrite").partitionBy("file_id").text(path)


def write_textgrids(intervals: DataFrame, path: str) -> None:
    """TextGrid files as write_per_file puts them."""
    write_per_file(textgrid_text(intervals), path)


#: Local files without checksum files beside them, for which Hadoop starts as many processes again.
_BARE_LOCAL = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def write_csv_per_file(df: DataFrame, path: str) -> None:
    """One directory of CSV per file_id, one file in each: a recording's rows meet in one task, however many tasks df has.
    The number of tasks is given, else few large ones would be left to write many small files."""
    n = shuffle_partitions(df.sparkSession)
    df.repartition(n, "file_id").write.mode("overwrite").options(**_BARE_LOCAL).option("header", True).option("escape", '"').partitionBy("file_id").csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """One CSV for results of report size, with a header even if there are no rows."""
    df.repartition(1).write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(path)


def empty_candidates(spark) -> DataFrame:
    """No candidates, all their columns."""
    return spark.createDataFrame([], S.CANDIDATES)


def summary_json(totals: DataFrame, parameters: dict[str, str]) -> DataFrame:
    """One JSON text of a one-row summary and its parameters."""
    p = F.create_map(*[F.lit(str(x)) for kv in parameters.items() for x in kv]) if parameters else F.create_map()
    return totals.select(F.to_json(F.struct(F.struct(*totals.columns).alias("totals"), p.alias("parameters"))).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_label_pair(sentences: DataFrame, order: list[str], path: str) -> None:
    """.dis and .labels directories, one file each, of lines in the same order (words and labels joined by spaces).

    Rows are sorted once, by order and then by their lines, and both files are written from that; a pair of files is
    one task's work, as line n of one belongs to line n of the other."""
    line = lambda c: F.concat_ws(" ", F.transform(c, lambda x: x.cast("string")))
    lines = sentences.select(*order, line("words").alias("_dis"), line("labels").alias("_labels"))
    ordered = written(lines.repartition(1).sortWithinPartitions(*order, "_dis", "_labels"), "pair")
    for c in ("dis", "labels"):
        one = ordered.select(*order, "_dis", "_labels").repartition(1).sortWithinPartitions(*order, "_dis", "_labels")
        one.select(F.col(f"_{c}").alias("value")).write.mode("overwrite").text(f"{path}.{c}")


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """A Markdown table of a report; refuses more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else "" if v is None else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def review_tiers(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """Interval rows for reviewing candidates by hand: words, gaps with their number, candidates with number and
    probability, predictions, and a tier to edit that begins as the predictions."""
    c = candidates.dropDuplicates(["file_id", "gap_index", "island_index"])
    given = ~F.isnan("candidate_start") & ~F.isnan("candidate_end") & (F.col("candidate_end") > F.col("candidate_start"))
    prob = F.when(F.col("prob_filler").isNull() | F.isnan("prob_filler"), "NA").otherwise(F.format_string("%.3f", "prob_filler"))
    tag: Column = F.concat(F.lit("g"), F.col("gap_index").cast("string"), F.lit(".i"), F.col("island_index").cast("string"))
    spans = lambda df, k, name, s, e, label: df.select("file_id", F.lit(k).alias("tier_idx"), F.lit(name).alias("tier"), F.col(s).alias("s"), F.col(e).alias("e"), label.alias("label")).distinct()
    predicted = c.filter(given & (F.col("pred_filler") == 1))
    every = [spans(words, 0, "words", "s", "e", F.col("label")), spans(c, 1, "gaps", "gap_start", "gap_end", F.concat(F.lit("g"), F.col("gap_index").cast("string"))),
             spans(c.filter(given), 2, "candidates", "candidate_start", "candidate_end", F.concat_ws(" ", tag, F.concat(F.lit("p="), prob), F.concat(F.lit("pred="), F.col("pred_filler").cast("string")))),
             spans(predicted, 3, "predicted", "candidate_start", "candidate_end", F.lit("filler")), spans(predicted, 4, "review", "candidate_start", "candidate_end", F.lit("filler"))]
    out = every[0]
    for e in every[1:]:
        out = out.unionByName(e)
    return out


def candidates_from_review(review: DataFrame, merge_gap: float = 0.0) -> DataFrame:
    """Candidate rows of an edited review tier (file_id, s, e, label): labelled stretches, merged, one per gap."""
    from speechloom.operators import intervals as I

    m = I.merge(review.filter(F.trim("label") != ""), ["file_id"], merge_gap)
    w = Window.partitionBy("file_id").orderBy("s")
    d = F.col("e") - F.col("s")
    none = lambda kind: F.lit(None).cast(kind)
    values = {"file_id": F.col("file_id"), "gap_index": F.row_number().over(w) - 1, "island_index": F.lit(0), "gap_start": F.col("s"), "gap_end": F.col("e"), "gap_duration": d, "vad_occupancy": F.lit(1.0), "n_voiced_islands": F.lit(1), "island_duration": d, "candidate_start": F.col("s"), "candidate_end": F.col("e"), "prob_filler": none("double"), "pred_filler": F.lit(1), "skip_reason": F.lit("manual_review")}
    return m.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in S.CANDIDATES])
