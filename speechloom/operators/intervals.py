"""Interval algebra over tidy tables: one row per interval with key columns, s and e (DOUBLE seconds), maybe label.

A key (a recording) may hold any share of the rows, so nothing is ordered along a whole key in one task: rows are ordered
inside blocks of time or of their number, and what a row needs from earlier blocks comes from one row per block (along).
Joins split a key by time bins. Rows whose s or e is null or NaN are left out (points of classify are kept, as 'end');
reversed intervals (e <= s) too, where said. Keys may be null: windows and aggregates take them as a group, joins of two
interval tables drop them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time block: ten minutes; rows of a block of numbered rows.
BLOCK, BLOCK_ROWS = 600.0, 50_000

_GIVEN = "s is not null and e is not null and not isnan(s) and not isnan(e)"
_USABLE = f"{_GIVEN} and e > s"


def time_block(s: str = "s", width: float = BLOCK) -> Column:
    return F.floor(F.col(s) / F.lit(width)).cast("bigint")


def row_block(idx: str, rows: int = BLOCK_ROWS) -> Column:
    return F.floor(F.col(idx) / F.lit(float(rows))).cast("bigint")


def _order(keys: list[str], *by: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*(by or ("s", "e")))


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def along(df: DataFrame, keys: list[str], block: Column, order: list[str], **what: tuple[str, str]) -> DataFrame:
    """df with a column per name that says something about the rows before or after along keys, in order.

    what: name = (kind, column). 'max', 'sum': of the column over the rows before (null, 0 for the first); 'lag',
    'lead': of the row before or after; 'last': last value that isn't null, this row's included. block: a number that
    doesn't fall in order. Windows run inside (keys, block); blocks hand on one row each, ordered along a key."""
    cell = ["_key", "_k"]
    rows = df.withColumns({"_key": F.struct(*keys), "_k": block})
    w, over = Window.partitionBy(*cell).orderBy(*order), Window.partitionBy("_key").orderBy("_k")
    upto, rank = w.rowsBetween(Window.unboundedPreceding, 0), F.struct(*order)
    boxed = lambda c: F.struct(F.col(c).alias("v"))
    here, summary, across, joined = {}, [], [], {}
    for name, (kind, c) in what.items():
        h, b = f"_here_{name}", f"_base_{name}"
        if kind == "max":
            here[h], per, base, joined[name] = F.max(c).over(_before(w)), F.max(c), F.max(b).over(_before(over)), F.greatest(h, b)
        elif kind == "sum":
            zero = F.lit(0)
            here[h], per, base, joined[name] = F.coalesce(F.sum(c).over(_before(w)), zero), F.sum(c), F.sum(b).over(_before(over)), F.col(h) + F.coalesce(b, zero)
        elif kind == "last":
            here[h], per, base, joined[name] = F.last(c, True).over(upto), F.max_by(c, F.when(F.col(c).isNotNull(), rank)), F.last(b, True).over(_before(over)), F.coalesce(h, b)
        elif kind == "lag":
            here[h], per, base, joined[name] = F.lag(boxed(c)).over(w), F.max_by(boxed(c), rank), F.lag(b).over(over), F.coalesce(h, b)["v"]
        else:
            here[h], per, base, joined[name] = F.lead(boxed(c)).over(w), F.min_by(boxed(c), rank), F.lead(b).over(over), F.coalesce(h, b)["v"]
        summary.append(per.alias(b))
        across.append(base.alias(b))
    blocks = rows.groupBy(*cell).agg(*summary).select(*cell, *across)
    return rows.withColumns(here).join(blocks, cell).withColumns(joined).select(*df.columns, *what)


def _runs(df: DataFrame, keys: list[str], block: Column, order: list[str], begins: Column) -> DataFrame:
    """df with _run, the order columns of the row that began its run; begins: Column over df, true for a run's first."""
    return along(df.withColumn("_at", F.when(begins, F.struct(*order))), keys, block, order, _run=("last", "_at")).drop("_at")


def _islands(df: DataFrame, keys: list[str], gap: float) -> DataFrame:
    w = _order(keys)
    reach = F.max("e").over(_before(w))
    df = df.withColumn("_new", (reach.isNull() | (F.col("s") > reach + F.lit(gap))).cast("int"))
    return df.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_g")


def merge(df: DataFrame, keys: list[str], gap: float = 0.0, split: float | None = BLOCK) -> DataFrame:
    """Union of intervals: those that overlap or lie at most gap apart become one. keys, s, e.

    split: width of time blocks that are merged on their own first; only what can reach into another block (at most two
    rows a block) is then ordered along a key. None: for keys that hold few rows each."""
    df = df.filter(_USABLE).select(*keys, "s", "e")
    if split is None:
        return _islands(df, keys, gap)
    cell = [*keys, "_k"]
    k = F.floor(F.col("s") / F.lit(split)).cast("bigint")
    local = _islands(df.withColumn("_k", k), cell, gap)
    reach = local.groupBy(*cell).agg(F.max("e").alias("_top")).withColumn("_reach", F.max("_top").over(_before(Window.partitionBy(*keys).orderBy("_k")))).drop("_top")
    reach = reach.filter(F.col("_reach") + gap >= F.col("_k") * split).withColumnsRenamed({n: f"_r{i}" for i, n in enumerate(cell)})
    seen = local.join(reach, [F.col(n).eqNullSafe(F.col(f"_r{i}")) for i, n in enumerate(cell)], "left")
    held = F.coalesce(F.col("s") <= F.col("_reach") + gap, F.lit(False))
    seen = seen.withColumn("_held", held).withColumn("_chain", F.col("_held") | F.lead("s").over(_order(cell)).isNull())
    links = seen.filter("_chain").groupBy(*cell, "_held").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return seen.filter("not _chain").select(*keys, "s", "e").unionByName(_islands(links.select(*keys, "s", "e"), keys, gap))


def merge_last_end(df: DataFrame, keys: list[str], gap: int, width: float = BLOCK) -> DataFrame:
    """Runs of intervals (e >= s) at most gap after the one before; a run ends where its last interval ends (not the
    furthest). width: of a time block, in units of s."""
    block, order = time_block("s", width), ["s", "e"]
    seen = along(df.select(*keys, "s", "e"), keys, block, order, _p=("lag", "e"))
    runs = _runs(seen, keys, block, order, F.coalesce(F.col("s") - F.col("_p") > gap, F.lit(True)))
    return runs.groupBy(*keys, "_run").agg(F.min("s").alias("s"), F.max_by("e", F.struct("s", "e")).alias("e")).drop("_run")


def gaps(df: DataFrame, keys: list[str], min_gap: float, start: float = 0.0, durations: DataFrame | None = None) -> DataFrame:
    """Stretches of at least min_gap that no interval covers: keys, s, e. From start on; durations (keys, duration)
    adds what is left at the end of a key, whole for keys without intervals."""
    rows = df.filter(_GIVEN).select(*keys, "s", "e")
    inner = along(rows, keys, time_block(), ["s", "e"], _top=("max", "e")).withColumn("_p", F.greatest(F.coalesce("_top", F.lit(start)), F.lit(start)))
    out = inner.filter(F.col("s") - F.col("_p") >= min_gap).select(*keys, F.col("_p").alias("s"), F.col("s").alias("e"))
    if durations is None:
        return out
    tail = durations.join(rows.groupBy(*keys).agg(F.max("e").alias("_p")), keys, "left").withColumn("_p", F.greatest(F.coalesce("_p", F.lit(start)), F.lit(start)))
    return out.unionByName(tail.filter(F.col("duration") - F.col("_p") >= min_gap).select(*keys, F.col("_p").alias("s"), F.col("duration").alias("e")))


def numbered_gaps(df: DataFrame, keys: list[str], min_gap: float, max_gap: float, durations: DataFrame | None = None) -> DataFrame:
    """gaps with gap_index from 0 along each key; gaps longer than max_gap take an index but no row."""
    g = along(gaps(df, keys, min_gap, 0.0, durations).withColumn("_one", F.lit(1).cast("bigint")), keys, time_block(), ["s", "e"], gap_index=("sum", "_one")).drop("_one")
    return g.filter(F.col("e") - F.col("s") <= max_gap)


def union_merge(a: DataFrame, b: DataFrame, keys: list[str], gap: float = 0.0) -> DataFrame:
    """The time that either of two interval sets covers: keys, s, e; intervals at most gap apart become one."""
    return merge(a.select(*keys, "s", "e").unionByName(b.select(*keys, "s", "e")), keys, gap)


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], bin_width: float = 30.0) -> DataFrame:
    """Overlapping pairs: keys, a's columns as a_*, b's as b_*, o_s, o_e. a and b need a row identity only if the
    caller wants to group by one.

    A range join by time bins: both sides go to the bins they touch, so a key with any share of the rows is spread
    over its bins; a pair is kept only in the bin where its overlap begins.
    """
    def binned(df: DataFrame, p: str) -> DataFrame:
        k = lambda c: F.floor(F.col(c) / F.lit(bin_width)).cast("bigint")
        df = df.filter(_USABLE).withColumn("_bin", F.explode(F.sequence(k("s"), k("e"))))
        return df.select(*keys, "_bin", *[F.col(c).alias(p + c) for c in df.columns if c not in (*keys, "_bin")])

    o = binned(a, "a_").join(binned(b, "b_"), [*keys, "_bin"])
    o = o.withColumn("o_s", F.greatest("a_s", "b_s")).withColumn("o_e", F.least("a_e", "b_e"))
    return o.filter((F.col("o_e") > F.col("o_s")) & (F.floor(F.col("o_s") / F.lit(bin_width)) == F.col("_bin"))).drop("_bin")


def hits(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the total time in both of two merged interval sets, and how many intervals of a any of b overlaps: keys,
    overlap, n_hit. One clip pass; times are summed as decimals, so that the order of summing doesn't show."""
    each = overlaps(a, b, keys).groupBy(*keys, "a_s", "a_e").agg(F.sum(exact(F.col("o_e") - F.col("o_s"))).alias("_o"))
    return each.groupBy(*keys).agg(F.sum("_o").cast("double").alias("overlap"), F.count(F.lit(1)).alias("n_hit"))


def exact(c: Column) -> Column:
    """A double as a decimal of nine places, whose sums don't depend on their order."""
    return c.cast("decimal(28,9)")


def contained_count(outer: DataFrame, inner: DataFrame, keys: list[str], counted: Column, bin_width: float = 30.0) -> DataFrame:
    """outer's rows with n, how many of inner's intervals that lie inside satisfy counted (a Column over inner).

    The bin of an inner interval's start lies among the bins of any outer interval around it."""
    k = lambda c: F.floor(F.col(c) / F.lit(bin_width)).cast("bigint")
    i = inner.filter(counted).select(*keys, k("s").alias("_bin"), F.col("s").alias("_s"), F.col("e").alias("_e"))
    rows = outer.withColumn("_bin", F.explode(F.sequence(k("s"), k("e"))))
    hit = (F.col("_s") >= F.col("s")) & (F.col("_e") <= F.col("e"))
    return rows.join(i, [*keys, "_bin"], "left").groupBy(*outer.columns).agg(F.count_if(F.coalesce(hit, F.lit(False))).cast("int").alias("n"))


def classify(points: DataFrame, spans: DataFrame, keys: list[str], order: str, tolerance: float = 0.15, bin_width: float = 30.0) -> DataFrame:
    """points (keys, s, e, ...) with location: by the first span (keys, s, e, order) in order that decides.

    A span decides 'end' if it ends less than tolerance from the point's start, else 'mid' if the point's middle lies
    inside; without a decision the location is 'end'. Spans go to the time bins they reach (tolerance included), points
    ask the bins of their start and middle; order values of a key are distinct.
    """
    k = lambda c: F.floor(c / F.lit(bin_width)).cast("bigint")
    c = spans.filter(_GIVEN).select(*keys, F.col("s").alias("_cs"), F.col("e").alias("_ce"), F.col(order).alias("_o"))
    c = c.withColumn("_bin", F.explode(F.sequence(k(F.col("_cs") - tolerance), k(F.greatest("_ce", "_cs") + tolerance))))
    mid = (F.col("s") + F.col("e")) / 2
    ends, inside = F.abs(F.col("s") - F.col("_ce")) < tolerance, (F.col("_cs") < mid) & (mid < F.col("_ce"))
    p = points.filter(_GIVEN).select(*keys, "s", "e").distinct()
    asked = p.withColumn("_bin", F.explode(F.array_distinct(F.array(k(F.col("s")), k(mid)))))
    first = asked.join(c, [*keys, "_bin"]).filter(ends | inside).groupBy(*keys, "s", "e").agg(F.min_by(F.when(ends, "end").otherwise("mid"), "_o").alias("_l"))
    return points.join(first, [*keys, "s", "e"], "left").withColumn("location", F.coalesce("_l", F.lit("end"))).drop("_l")


def subtract(pauses: DataFrame, islands: DataFrame, keys: list[str], min_part: float, merge_gap: float = 0.03) -> DataFrame:
    """What is left of each pause without the islands inside it: keys, s, e, p_s, p_e (the pause), n_islands.

    Overlaps of a pause are clipped to it and merged (merge_gap); parts shorter than min_part go, and a pause that is
    covered vanishes. Untouched pauses stay whatever their length, with n_islands 0.
    """
    pauses = pauses.select(*keys, "s", "e").distinct()
    cut = overlaps(pauses, islands.select(*keys, "s", "e"), keys).select(*keys, F.col("a_s").alias("p_s"), F.col("a_e").alias("p_e"), F.col("o_s").alias("s"), F.col("o_e").alias("e"))
    by = [*keys, "p_s", "p_e"]
    m = merge(cut, by, merge_gap, None)  # a pause holds few islands
    w = _order(by)
    touched = m.withColumn("_from", F.coalesce(F.lag("e").over(w), F.col("p_s"))).withColumn("_last", F.lead("s").over(w).isNull()).withColumn("n_islands", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    parts = touched.select(*by, "n_islands", F.explode(F.array(F.struct(F.col("_from").alias("s"), F.col("s").alias("e")), F.when(F.col("_last"), F.struct(F.col("e").alias("s"), F.col("p_e").alias("e"))))).alias("_x"))
    parts = parts.filter((F.col("_x.e") - F.col("_x.s")) >= min_part).select(*keys, "_x.s", "_x.e", "p_s", "p_e", "n_islands")
    whole = pauses.join(cut.select(*keys, F.col("p_s").alias("s"), F.col("p_e").alias("e")).distinct(), [*keys, "s", "e"], "left_anti")
    return parts.unionByName(whole.select(*keys, "s", "e", F.col("s").alias("p_s"), F.col("e").alias("p_e"), F.lit(0).cast("bigint").alias("n_islands")))


def patch(tier: DataFrame, islands: DataFrame, keys: list[str], is_pause: Column, label: str, merge_gap: float = 0.02, eps: float = 1e-4) -> DataFrame:
    """Tier (keys, s, e, label) with the islands cut into its pauses under the given label: keys, s, e, label.

    Islands are merged (merge_gap); pieces no longer than eps go; neighbours that meet and share a label become one.
    """
    tier = tier.filter("e > s").select(*keys, "s", "e", "label").distinct()
    cut = overlaps(tier.filter(is_pause), merge(islands, keys, merge_gap), keys)
    by = [*keys, "a_s", "a_e", "a_label"]
    w = Window.partitionBy(*by).orderBy("o_s")
    cut = cut.withColumn("_from", F.coalesce(F.lag("o_e").over(w), F.col("a_s"))).withColumn("_last", F.lead("o_s").over(w).isNull())
    piece = lambda a, b, lab: F.struct(a.alias("s"), b.alias("e"), lab.alias("label"))
    pieces = cut.select(*keys, F.explode(F.array_compact(F.array(
        piece(F.col("_from"), F.col("o_s"), F.col("a_label")), piece(F.col("o_s"), F.col("o_e"), F.lit(label)), F.when(F.col("_last"), piece(F.col("o_e"), F.col("a_e"), F.col("a_label"))),
    ))).alias("_x")).filter(F.col("_x.e") - F.col("_x.s") > eps).select(*keys, "_x.*")
    untouched = tier.join(cut.select(*keys, F.col("a_s").alias("s"), F.col("a_e").alias("e"), F.col("a_label").alias("label")).distinct(), [*keys, "s", "e", "label"], "left_anti")
    return coalesce_equal(untouched.unionByName(pieces), keys)


def coalesce_equal(tier: DataFrame, keys: list[str], eps: float = 1e-6) -> DataFrame:
    """Neighbours that meet (within eps) and share a label become one: keys, s, e, label."""
    order = ["s", "e"]
    t = along(tier.select(*keys, "s", "e", "label"), keys, time_block(), order, _p=("lag", "e"), _l=("lag", "label"))
    same = (F.abs(F.col("s") - F.col("_p")) < eps) & (F.col("label") == F.col("_l"))
    runs = _runs(t, keys, time_block(), order, F.coalesce(~same, F.lit(True)))
    return runs.groupBy(*keys, "_run", "label").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(*keys, "s", "e", "label")


def run_units(words: DataFrame, keys: list[str], order: str, breaks: Column, units: Column) -> DataFrame:
    """Units between breaks: keys, run, units; runs without units are left out."""
    w = along(words.withColumn("_b", F.coalesce(breaks, F.lit(False)).cast("bigint")), keys, row_block(order), [order], _n=("sum", "_b"))
    return w.withColumn("run", F.col("_n") + F.col("_b")).groupBy(*keys, "run").agg(F.sum(units).alias("units")).filter("units > 0")


def clean_nonoverlap(df: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """Intervals clamped to [low, high] and started no earlier than the one before ended: keys, s, e, label; empty ones
    go. low and high are Columns over df, constant per key."""
    rows = df.filter(_GIVEN).select("*", F.greatest("s", low).alias("_s"), F.least("e", high).alias("_e")).filter("_e > _s")
    rows = along(rows, keys, time_block(), ["s", "e", "label"], _cursor=("max", "_e"))
    return rows.withColumn("_c", F.greatest("_s", F.coalesce("_cursor", "_s"))).filter("_e > _c").select(*keys, F.col("_c").alias("s"), F.col("_e").alias("e"), "label")


def fill_timeline(df: DataFrame, keys: list[str], bounds: DataFrame) -> DataFrame:
    """clean_nonoverlap within bounds (keys, low, high) with blank intervals in the holes; keys without intervals get one blank."""
    clean = clean_nonoverlap(df.join(bounds, keys), keys, F.col("low"), F.col("high"))
    # Bounds count as an empty interval at their start, so every hole but the last lies before an interval.
    edge = bounds.select(*keys, F.col("low").alias("s"), F.col("low").alias("e"), F.lit("").alias("label"))
    placed = along(clean.unionByName(edge), keys, time_block(), ["s", "e"], _p=("max", "e"))
    own, hole = F.struct("s", "e", "label"), F.struct(F.col("_p").alias("s"), F.col("s").alias("e"), F.lit("").alias("label"))
    pieces = placed.select(*keys, F.explode(F.array_compact(F.array(F.when(F.col("e") > F.col("s"), own), F.when(F.col("s") > F.col("_p"), hole)))).alias("x")).select(*keys, "x.*")
    tail = bounds.join(clean.groupBy(*keys).agg(F.max("e").alias("_p")), keys, "left").withColumn("_p", F.coalesce("_p", "low")).filter("_p < high").select(*keys, F.col("_p").alias("s"), F.col("high").alias("e"), F.lit("").alias("label"))
    return pieces.unionByName(tail)


def offsets(df: DataFrame, keys: list[str], order: str, size: Column) -> DataFrame:
    """df with offset: sum of size over the rows before in order."""
    return along(df.withColumn("_size", size.cast("bigint")), keys, row_block(order), [order], offset=("sum", "_size")).drop("_size")


def blank_outside(tier: DataFrame, keys: list[str], span: DataFrame) -> DataFrame:
    """Labels of intervals that start before span's first, or end after its last, become blank; boundaries stay.

    span: keys, first, last (null: no bound). Keys without a span stay as they are."""
    t = tier.join(span, keys, "left")
    out = (F.col("s") < F.col("first")) | (F.col("e") > F.col("last"))
    return t.withColumn("label", F.when(F.coalesce(out, F.lit(False)), "").otherwise(F.col("label"))).drop("first", "last")


def speech_span(tier: DataFrame, keys: list[str], is_blank: Column) -> DataFrame:
    """Start of the first and end of the last interval that isn't blank: keys, first, last."""
    return tier.filter(~is_blank).groupBy(*keys).agg(F.min_by("s", F.struct("s", "e")).alias("first"), F.max_by("e", F.struct("s", "e")).alias("last"))
