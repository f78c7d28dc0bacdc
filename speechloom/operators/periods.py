"""Continuous periods and the holes between them, from overlapping, nested, touching and gapped intervals.

Method. Every interval becomes a session whose length is its own duration (``session_window`` with a per-row
duration), merged by Spark's session aggregation. To keep a recording that holds a large share of all rows from
landing in one task, intervals are first cut at fixed time buckets of the recording and merged inside each bucket: an
interval gives the piece in its first bucket, the piece in its last and, if it reaches over whole buckets, one piece for
all of them, held by the first of these. Along a recording's buckets the furthest reach of those before tells which
buckets are covered whole; such a bucket counts as one piece. What touches a bucket's edge (at most two sessions a
bucket) is then chained along the recording by a second session aggregation. Holes come from ``lead``, inside each bucket
and, between buckets, over one row per bucket.

What a task holds: the pieces of one (recording, bucket), identical ones combined before the shuffle, or one row per
bucket of one recording that an interval begins or ends in, which is bounded by the recording's length over the bucket
width, not by the number of rows. An interval of any length makes at most three pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of time a second is counted in (0.0001 s).
UNITS_PER_SECOND = 10_000
#: Width of a merge bucket, in units: two minutes.
BUCKET_UNITS = 120 * UNITS_PER_SECOND


def to_units(seconds: Column, units: int = UNITS_PER_SECOND) -> Column:
    """round(seconds x units) as BIGINT; null where seconds is null, NaN or infinite. A finite time beyond a BIGINT
    raises, as casts do."""
    given = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < F.lit(float("inf")))
    return F.when(given, F.round(F.when(given, seconds) * F.lit(float(units))).cast("bigint"))


def unpivot_spans(df: DataFrame, keys: list[str], spans: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per row and span kind in a single scan: keys, field, begin, finish (units). Rows without both times or
    with finish <= begin are left out."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), to_units(F.col(a)).alias("begin"), to_units(F.col(b)).alias("finish")) for name, (a, b) in spans.items()])
    return df.select(*keys, F.explode(pairs).alias("_s")).select(*keys, "_s.field", "_s.begin", "_s.finish").filter("begin is not null and finish is not null and finish > begin")


def _sessions(df: DataFrame, by: list[str]) -> DataFrame:
    """Sessions of rows (begin, finish, least/greatest begin and finish of the members) by keys; touching ones join."""
    length = F.expr("make_interval(0, 0, 0, 0, 0, 0, cast(finish - begin as decimal(18, 0)) / 1000000)")
    return (
        df.withColumn("_at", F.timestamp_micros("begin"))
        .groupBy(*by, F.session_window("_at", length).alias("_w"))
        .agg(
            F.min("begin").alias("begin"), F.max("finish").alias("finish"), F.min("first_begin").alias("first_begin"), F.max("last_begin").alias("last_begin"),
            F.min("first_finish").alias("first_finish"), F.max("last_finish").alias("last_finish"),
        )
        .drop("_w")
    )


def periods_and_holes(intervals: DataFrame, keys: list[str], max_hole: int | None = None, bucket: int = BUCKET_UNITS) -> DataFrame:
    """Periods and the holes between neighbouring periods: keys, kind ('period', 'hole'), begin, finish, several.

    intervals: keys, begin, finish BIGINT; other columns are ignored, names beginning with '_' are reserved. several
    says whether at least two distinct intervals made the period; it is null for holes. max_hole: longest hole
    reported, in units. Periods of one key never overlap or touch.
    Null begin or finish and finish <= begin: the row is left out. Null keys form a group of their own. Repeated rows
    count once. An empty table gives an empty result.
    """
    bucket_of = lambda c: F.expr(f"({c} - pmod({c}, {bucket})) div {bucket}")
    # A key as one struct joins like any other value where parts of it are null.
    cell = ["_key", "_k"]
    piece_of = lambda k, b, f: F.struct(k.alias("_k"), b.alias("begin"), f.alias("finish"))
    a, z = F.col("_a"), F.col("_z")
    cut = F.array_compact(F.array(
        piece_of(a, F.col("first_begin"), F.least("first_finish", (a + 1) * bucket)), F.when(z > a, piece_of(z, z * bucket, F.col("first_finish"))), F.when(z > a + 1, piece_of(a + 1, (a + 1) * bucket, z * bucket))))
    pieces = (
        intervals.filter("begin is not null and finish is not null and finish > begin")
        .select(F.struct(*keys).alias("_key"), *[F.col("begin").alias(n) for n in ("first_begin", "last_begin")], *[F.col("finish").alias(n) for n in ("first_finish", "last_finish")], bucket_of("begin").alias("_a"), bucket_of("(finish - 1)").alias("_z"))
        .select("_key", "first_begin", "last_begin", "first_finish", "last_finish", F.explode(cut).alias("_p")).select("_key", "_p.*", "first_begin", "last_begin", "first_finish", "last_finish")
    )
    # begin, finish; the members' greatest begin and least finish, and their least begin and greatest finish.
    merged = _sessions(pieces, cell)
    row = Window.partitionBy(*cell).orderBy("begin")
    start, end = F.col("_k") * bucket, (F.col("_k") + 1) * bucket
    at_start, at_end = F.col("begin") == start, F.col("finish") >= end
    several = (F.col("first_begin") != F.col("last_begin")) | (F.col("first_finish") != F.col("last_finish"))
    names = ("begin", "finish", "first_begin", "last_begin", "first_finish", "last_finish")
    per_bucket = merged.groupBy(*cell).agg(
        F.min("begin").alias("_first"), F.max("finish").alias("_end"),
        F.collect_list(F.when(at_start | at_end, F.struct(*names))).alias("_edges"),  # at most two
        *[(F.max if n.startswith("last") else F.min)(n).alias(n) for n in names[2:]],
    )
    along = Window.partitionBy("_key").orderBy("_k")
    reach = F.max("_end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    placed = per_bucket.withColumns({"_reach": reach, "_ahead": F.lead("_first").over(along)}).withColumn("_covered", F.coalesce(F.col("_reach") >= end, F.lit(False)))
    # Covered buckets are asked for with all columns in hand (always there), so both uses share their shuffles.
    covered = placed.filter(F.col("_covered") & (F.size("_edges") >= 0) & (F.col("_first") <= F.col("_end")) & F.greatest(*names[2:]).isNotNull()).select(*cell)
    out = lambda kind, b, f, s: F.struct(F.lit(kind).alias("kind"), b.alias("begin"), f.alias("finish"), s.cast("boolean").alias("several"))
    inside = (
        merged.withColumn("_next", F.lead("begin").over(row)).join(covered, cell, "left_anti")
        .select("_key", F.explode(F.array_compact(F.array(
            F.when(~(at_start | at_end), out("period", F.col("begin"), F.col("finish"), several)),
            F.when(F.col("_next").isNotNull(), out("hole", F.col("finish"), F.col("_next"), F.lit(None))),
        ))).alias("_r")).select("_key.*", "_r.*")
    )
    whole = F.struct(start.alias("begin"), F.greatest("_end", end).alias("finish"), *names[2:])
    top = F.greatest("_reach", "_end")
    gap = F.struct(*[c.alias(n) for n, c in zip(names, (top, F.col("_ahead")) * 3)])
    between = placed.select("_key", F.explode(F.concat(
        F.transform(F.when(F.col("_covered"), F.array(whole)).otherwise(F.col("_edges")), lambda e: F.struct(F.lit("period").alias("kind"), e.alias("e"))),
        F.when(F.col("_ahead") > top, F.array(F.struct(F.lit("hole").alias("kind"), gap.alias("e")))).otherwise(F.array()),
    )).alias("_r")).select("_key", "_r.kind", "_r.e.*")
    # Holes never touch each other, so they go through the session aggregation unchanged.
    chained = _sessions(between, ["_key", "kind"]).select("_key.*", "kind", "begin", "finish", F.when(F.col("kind") == "period", several).alias("several"))
    found = inside.unionByName(chained)
    return found if max_hole is None else found.filter((F.col("kind") != "hole") | (F.col("finish") - F.col("begin") <= max_hole))


def merge_periods(intervals: DataFrame, keys: list[str], bucket: int = BUCKET_UNITS) -> DataFrame:
    """The periods alone: keys, begin, finish, several. Cases as in periods_and_holes."""
    return periods_and_holes(intervals, keys, None, bucket).filter("kind = 'period'").drop("kind")
