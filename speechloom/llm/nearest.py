"""Nearest record in time of the same entity within a tolerance, by expanding-ring joins.

Method. Both sides are cut into time blocks of an entity and partitioned once by (entity, block); right points near a
block's edge are kept in both blocks, so each left row finds all its partners in its own block. Ring r joins the left
rows still unresolved to the right points in the adjacent buckets of width 2w_r that can hold points within w_r; a
match at most w_r away is provably the nearest, as every point that near was seen, and is accepted. The others go on
to w_(r+1) = 2 w_r, up to the tolerance. All rings run on the one partitioning: their keys (entity, block, bucket)
refine it, so no ring shuffles again.

What a task holds: rows of one (entity, block). The right side keeps one point per distinct time, so a block of B units
holds at most B + 2 tolerance points whatever the number of rows; the left side streams through sort-merge joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.operators.periods import to_units
from speechloom.session import shuffle_partitions, written

#: Nearest words are looked for up to this far away (0.15 s in units of 0.0001 s).
TOLERANCE = 1_500
#: Half width of the first, finest ring; doubled until it reaches the tolerance.
FIRST_RING = 375
#: Width of a partitioning block: 30 s.
BLOCK = 300_000
_POS_BITS = 31


def _bucket(t: Column, width: int) -> Column:
    return F.floor(t / F.lit(float(width))).cast("bigint")


def point_ref(major: Column, minor: Column) -> Column:
    """(major, minor), two INTs with minor >= 0, as one BIGINT that sorts alike."""
    return F.shiftleft(major.cast("bigint"), _POS_BITS) + minor.cast("bigint")


def nearest_in_time(left: DataFrame, right: DataFrame, entity: str, tolerance: int = TOLERANCE, first_ring: int = FIRST_RING, block: int = BLOCK) -> DataFrame:
    """Each left row with its nearest right point.

    left: entity, t BIGINT and any further columns (which name the row; exact repeats count once; no name may begin with
    '_'). right: entity, ts ARRAY<STRUCT<t BIGINT, ref BIGINT>>, points packed by row. Returns the left columns,
    distance and ref, for the left rows that have a point within tolerance; left columns of these two names are left
    out of the result. Ties go to the smallest ref.
    The result is computed when this is called and written to the shared folder.
    Null entity or t, null arrays and null points: never matched, left out. Empty tables give an empty result.
    """
    spark = left.sparkSession
    n = shuffle_partitions(spark)
    names = left.columns
    todo = (
        left.filter(F.col(entity).isNotNull() & F.col("t").isNotNull()).dropDuplicates().withColumn("_block", _bucket(F.col("t"), block))
        .repartition(n, F.col(entity), F.col("_block"))
        .withColumn("_d", F.lit(None).cast("bigint")).withColumn("_ref", F.lit(None).cast("bigint"))
    )
    packed = right.filter(F.col(entity).isNotNull()).select(entity, F.filter("ts", lambda p: p["t"].isNotNull() & p["ref"].isNotNull()).alias("ts")).filter(F.size("ts") > 0)
    cells = F.array_distinct(F.flatten(F.transform("ts", lambda p: F.sequence(_bucket(p["t"] - tolerance, block), _bucket(p["t"] + tolerance, block)))))
    lies_in = lambda p: (p["t"] >= F.col("_block") * block - tolerance) & (p["t"] < (F.col("_block") + 1) * block + tolerance)
    points = (
        packed.withColumn("_block", F.explode(cells)).withColumn("ts", F.filter("ts", lies_in))
        .select(entity, "_block", F.transform("ts", lambda p: p["t"]).alias("_ts"), F.transform("ts", lambda p: p["ref"]).alias("_refs"))
        .dropDuplicates().repartition(n, F.col(entity), F.col("_block"))
        .select(entity, "_block", F.explode(F.arrays_zip("_ts", "_refs")).alias("_p"))
        .groupBy(entity, "_block", F.col("_p._ts").alias("_pt")).agg(F.min("_p._refs").alias("_pref"))
    )
    ring = first_ring
    while True:
        w = min(ring, tolerance)
        probes = F.array_distinct(F.array(_bucket(F.col("t") - w, 2 * w), _bucket(F.col("t") + w, 2 * w)))
        asked = todo.withColumn("_bucket", F.explode_outer(F.when(F.col("_d").isNull(), probes)))
        at = points.withColumn("_bucket", _bucket(F.col("_pt"), 2 * w))
        far = F.abs(F.col("t") - F.col("_pt"))
        best = F.min(F.when(far <= w, F.struct(far.alias("d"), F.col("_pref").alias("ref")))).alias("_best")
        todo = (
            asked.join(at, [entity, "_block", "_bucket"], "left").groupBy(*names, "_block", "_d", "_ref").agg(best)
            .select(*names, "_block", F.coalesce("_d", "_best.d").alias("_d"), F.coalesce("_ref", "_best.ref").alias("_ref"))
        )
        if w >= tolerance:
            break
        ring *= 2
    found = todo.filter("_d is not null").select(*[c for c in names if c not in ("distance", "ref")], F.col("_d").alias("distance"), F.col("_ref").alias("ref"))
    # The rings' join keys refine the partitioning by (entity, block); without this setting Spark would shuffle for each
    # ring (15 exchanges for 6). It holds while the result is written, no longer.
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return written(found, "nearest")
    finally:
        spark.conf.set(setting, before)


def word_points(asr: DataFrame) -> DataFrame:
    """Start and end points of the usable words of asr_json rows: file_id, ts ARRAY<STRUCT<t, ref>>; ref is
    point_ref(chunk_no, word_pos). Usable: not blank, both times given, end > start. Null words or chunks: no points."""
    blank = r"^[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*$"
    usable = lambda w: w["word"].isNotNull() & ~w["word"].rlike(blank) & ~F.isnan(w["start"]) & ~F.isnan(w["end"]) & (w["end"] > w["start"])
    numbered = F.transform("words", lambda w, i: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end"), i.alias("pos")))
    both = lambda w: F.array(*[F.struct(to_units(w[c]).alias("t"), point_ref(F.col("chunk_no"), w["pos"]).alias("ref")) for c in ("start", "end")])
    return asr.select("file_id", F.flatten(F.transform(F.filter(numbered, usable), both)).alias("ts"))
