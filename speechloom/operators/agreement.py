"""Agreement and correlation statistics as grouped aggregations.

All work on long tables: group columns plus a and b (two measurements of one thing), or two boolean labels. Nothing but
sums leaves the map side, apart from ranks and percentiles, which are made from counts per value.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from speechloom.functions.text import ratio
from speechloom.session import written


def _by(df: DataFrame, by: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs)


def _r(a: str, b: str) -> Column:
    return F.when(F.count(F.lit(1)) > 1, F.expr(f"try_divide(covar_pop({a}, {b}), stddev_pop({a}) * stddev_pop({b}))"))


def pearson(df: DataFrame, by: list[str]) -> DataFrame:
    """by, n, pearson_r, bias (mean of a - b), mae, mean_a, mean_b over rows with both values.

    r is null where a or b doesn't vary or n < 2."""
    df = df.filter("a is not null and b is not null")
    return _by(df, by, F.count(F.lit(1)).alias("n"), _r("a", "b").alias("pearson_r"), F.avg(F.col("a") - F.col("b")).alias("bias"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))


def average_rank(column: str, by: list[str]) -> Column:
    """Rank from 1 in a group; equal values share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, column)) - 1) / 2


#: Blocks a group's values are cut into, by approximate quantiles.
VALUE_BLOCKS = 64


def cumulative(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts (by, v, n; one row per value) with before, how many rows of the group have a smaller value, and total, its
    rows; for groups of any size.

    Hot values collapse in the counts. These are summed along the values inside blocks found by approximate quantiles of
    the group, and only block totals are summed over a group. The counts are written once, as they are read three times."""
    counts = written(counts.select(*by, "v", "n"), "counts").withColumn("_g", F.struct(F.lit(0), *by))
    cuts = counts.groupBy("_g").agg(F.percentile_approx("v", [i / VALUE_BLOCKS for i in range(1, VALUE_BLOCKS)], 1000).alias("_cuts"))
    placed = counts.join(cuts, "_g").withColumn("_k", F.size(F.filter("_cuts", lambda c: c < F.col("v")))).drop("_cuts")
    prior = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_in", F.coalesce(F.sum("n").over(prior(Window.partitionBy("_g", "_k").orderBy("v"))), F.lit(0)))
    group = Window.partitionBy("_g")
    blocks = placed.groupBy("_g", "_k").agg(F.sum("n").alias("_t")).select("_g", "_k", F.coalesce(F.sum("_t").over(prior(group.orderBy("_k"))), F.lit(0)).alias("_base"), F.sum("_t").over(group).alias("total"))
    return inside.join(blocks, ["_g", "_k"]).select(*by, "v", "n", (F.col("_base") + F.col("_in")).alias("before"), "total")


def average_ranks(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, v, rank: the average rank from 1 of each value of counts (by, v, n), and total."""
    return cumulative(counts, by).select(*by, "v", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"), "total")


def percentiles(values: DataFrame, by: list[str], at: tuple[float, ...]) -> DataFrame:
    """by, and p0, p1, ... the exact percentiles of v (linear between neighbours) at the given shares, for groups of any
    size. Nulls and NaN are left out."""
    counts = values.filter("v is not null and not isnan(v)").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    c = cumulative(counts, by)
    place = [F.lit(q) * (F.col("total") - 1) for q in at]
    holds = lambda p: (F.col("before") <= p) & (p < F.col("before") + F.col("n"))
    sides = [(F.max(F.when(holds(F.floor(p)), F.col("v"))).alias(f"_lo{i}"), F.max(F.when(holds(F.ceil(p)), F.col("v"))).alias(f"_hi{i}"), F.max(p - F.floor(p)).alias(f"_w{i}")) for i, p in enumerate(place)]
    found = c.groupBy(*by).agg(*[x for s in sides for x in s])
    return found.select(*by, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(f"p{i}") for i in range(len(at))])


def spearman(df: DataFrame, by: list[str]) -> DataFrame:
    """by, n, spearman_rho: the correlation of average ranks, over rows with both values. Null where a or b doesn't vary.

    Rows collapse to pairs of values and these to values, so ranks join pairs; only a value paired with very many others
    stays heavy, which the adaptive skew join splits."""
    pairs = written(df.filter("a is not null and b is not null").groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs")
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).cast("double").alias("v"))
    counts = pairs.select(*by, "n", F.explode(F.array(side("a"), side("b"))).alias("x")).groupBy(*by, "x.side", "x.v").agg(F.sum("n").alias("n"))
    ranks = average_ranks(counts, [*by, "side"])
    of = lambda name: ranks.filter(F.col("side") == name).select(F.struct(F.lit(0), *by).alias("_g"), F.col("v").alias(f"_{name}"), (F.col("rank") - (F.col("total") + 1) / 2).alias(f"_r{name}"))
    p = pairs.select(*by, "n", F.struct(F.lit(0), *by).alias("_g"), F.col("a").cast("double").alias("_a"), F.col("b").cast("double").alias("_b")).join(of("a"), ["_g", "_a"]).join(of("b"), ["_g", "_b"])
    # Ranks are centred, so their sums of products are the covariance and the variances.
    s = _by(p, by, F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_ra") * F.col("_rb")).alias("_ab"), F.sum(F.col("n") * F.col("_ra") * F.col("_ra")).alias("_aa"), F.sum(F.col("n") * F.col("_rb") * F.col("_rb")).alias("_bb"))
    return s.select(*by, "n", F.try_divide("_ab", F.sqrt("_aa") * F.sqrt("_bb")).alias("spearman_rho"))


def spearman_small(df: DataFrame, by: list[str]) -> DataFrame:
    """spearman for groups that are known to fit a task: ranks are made by ordering each group in one."""
    df = df.filter("a is not null and b is not null").select(*by, average_rank("a", by).alias("a"), average_rank("b", by).alias("b"))
    return pearson(df, by).select(*by, "n", F.col("pearson_r").alias("spearman_rho"))


def icc_2_1(df: DataFrame, by: list[str]) -> DataFrame:
    """by, n, icc_2_1: two-way random effects, absolute agreement, single of two raters. 1 where the denominator
    vanishes; null for fewer than two rows. Values are centred on the group's means of a first, against cancellation."""
    if not by:
        return icc_2_1(df.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
    df = df.filter("a is not null and b is not null")
    c = df.join(df.groupBy(*by).agg(F.avg("a").alias("_c")), by)
    return _icc(_by(c, by, F.count(F.lit(1)).alias("n"), *_icc_sums())).select(*by, "n", "icc_2_1")


def _icc_sums() -> list[Column]:
    """Sums that icc_2_1 is made of, over a, b and _c, a value near both."""
    x, y = F.col("a") - F.col("_c"), F.col("b") - F.col("_c")
    return [F.avg(x).alias("_ca"), F.avg(y).alias("_cb"), F.sum(x * x + y * y).alias("_ss"), F.sum((x + y) * (x + y) / 4).alias("_srr")]


def _icc(s: DataFrame) -> DataFrame:
    """s (n and _icc_sums) with icc_2_1."""
    n, gm = F.col("n"), (F.col("_ca") + F.col("_cb")) / 2
    ssr = 2 * (F.col("_srr") - n * gm * gm)
    ssc = n * ((F.col("_ca") - gm) * (F.col("_ca") - gm) + (F.col("_cb") - gm) * (F.col("_cb") - gm))
    sst = F.col("_ss") - 2 * n * gm * gm
    free = F.when(n > 1, n - 1)
    s = s.withColumns({"_msr": ssr / free, "_msc": ssc, "_mse": (sst - ssr - ssc) / free})
    den = F.col("_msr") + F.col("_mse") + F.lit(2.0) / n * (F.col("_msc") - F.col("_mse"))
    return s.withColumn("icc_2_1", F.when(F.abs(den) < 1e-15, 1.0).otherwise(F.try_divide(F.col("_msr") - F.col("_mse"), den))).drop("_msr", "_msc", "_mse", "_ca", "_cb", "_ss", "_srr")


def confusion(df: DataFrame, by: list[str]) -> DataFrame:
    """by, tp, fp, fn, tn of boolean columns auto and gold."""
    a, g = F.col("auto"), F.col("gold")
    return _by(df, by, *[F.count_if(c).alias(n) for n, c in (("tp", a & g), ("fp", a & ~g), ("fn", ~a & g), ("tn", ~a & ~g))])


def scores(c: DataFrame, empty_pr: float = 1.0) -> DataFrame:
    """confusion's rows with accuracy, precision, recall (empty_pr where undefined), f1 (0 where undefined), kappa (1
    where chance agreement is full)."""
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), empty_pr), ratio(F.col("tp"), F.col("tp") + F.col("fn"), empty_pr)
    obs = ratio(F.col("tp") + F.col("tn"), n, 1.0)
    pa, pg = ratio(F.col("tp") + F.col("fp"), n), ratio(F.col("tp") + F.col("fn"), n)
    chance = pa * pg + (1 - pa) * (1 - pg)
    return c.withColumns({"accuracy": obs, "precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "kappa": F.when(F.abs(1 - chance) > 1e-12, F.try_divide(obs - chance, 1 - chance)).otherwise(1.0)})


def location_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """Agreement of two pause locations (auto, gold: 'mid' or 'end'): by, n, kappa, accuracy, mcp_*, ecp_* (p, r, f1).

    Undefined scores are 0; with fewer than two pauses all are."""
    c = _by(df, by, F.count(F.lit(1)).alias("n"), *[F.count_if((F.col("auto") == a) & (F.col("gold") == g)).alias(f"{a}_{g}") for a in ("mid", "end") for g in ("mid", "end")])
    n = F.col("n")
    agree = F.col("mid_mid") + F.col("end_end")
    am, gm = F.col("mid_mid") + F.col("mid_end"), F.col("mid_mid") + F.col("end_mid")
    chance = ratio(am * gm + (n - am) * (n - gm), n * n)
    out = {"kappa": F.when(F.abs(1 - chance) > 1e-12, F.try_divide(agree / n - chance, 1 - chance)).otherwise(1.0), "accuracy": ratio(agree, n)}
    for name, hit, said, true in (("mcp", F.col("mid_mid"), am, gm), ("ecp", F.col("end_end"), n - am, n - gm)):
        p, r = ratio(hit, said), ratio(hit, true)
        out |= {f"{name}_p": p, f"{name}_r": r, f"{name}_f1": ratio(2 * p * r, p + r)}
    return c.select(*by, "n", *[F.when(n < 2, 0.0).otherwise(v).alias(k) for k, v in out.items()])


def file_agreement(files: DataFrame, located: DataFrame) -> DataFrame:
    """file_id, n_pauses, n_agree, accuracy of every file of files: located (file_id, auto, gold) counts where auto and
    gold agree; files without a row have zeros."""
    n = located.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_pauses"), F.count_if(F.col("auto") == F.col("gold")).alias("n_agree"))
    every = files.select("file_id").distinct().join(n, "file_id", "left").fillna(0, ["n_pauses", "n_agree"])
    return every.withColumn("accuracy", ratio(F.col("n_agree"), F.col("n_pauses")))


def macro(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Means over files of the columns, NaN left out (null where nothing is left): by, n_files, macro_<column>."""
    return _by(df, by, F.count(F.lit(1)).alias("n_files"), *[F.avg(F.when(~F.isnan(c), F.col(c))).alias(f"macro_{c}") for c in columns])


def roc_auc(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """by, n_pos, n_neg, auc by average ranks; null where a class is missing."""
    seen = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("v")).agg(F.count_if(positive).alias("p"), F.count(F.lit(1)).alias("n"))
    seen = written(seen, "scores")
    key = [F.struct(F.lit(0), *by).alias("_g"), "v"]
    ranked = seen.select(*by, "p", "n", *key).join(average_ranks(seen, by).select(*key, "rank"), ["_g", "v"])
    s = _by(ranked, by, F.sum("p").alias("n_pos"), F.sum(F.col("n") - F.col("p")).alias("n_neg"), F.sum(F.col("p") * F.col("rank")).alias("_s"))
    n = F.col("n_pos").cast("double")
    return s.select(*by, "n_pos", "n_neg", F.try_divide(F.col("_s") - n * (n + 1) / 2, n * F.col("n_neg")).alias("auc"))


def describe(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Long table by, measure, count, mean, std (sample), min, p25, p50, p75, max (exact, linear between neighbours)."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*by, "x.*").filter("v is not null and not isnan(v)")
    long, by = written(long, "measures"), [*by, "measure"]
    g = F.struct(F.lit(0), *by).alias("_g")
    plain = _by(long, by, F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")).withColumn("_g", g)
    p = percentiles(long, by, (0.25, 0.5, 0.75)).select(g, F.col("p0").alias("p25"), F.col("p1").alias("p50"), F.col("p2").alias("p75"))
    return plain.join(p, "_g").select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def _tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t, by the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x or 5e-324) + b * math.log1p(-x)) if x < 1 else 1.0

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
        h = d
        for m in range(1, 300):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + k * d or tiny)
                c = 1 + k / c or tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    if x >= 1:
        return 1.0
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def p_value(r: str, n: str) -> Column:
    """Two-sided p of a correlation of n pairs (t approximation), as an Arrow UDF; null for null, n < 3."""

    @F.pandas_udf("double")
    def tail(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rs, ns in it:
            yield pd.Series([None if x is None or math.isnan(x) or k < 3 else _tail(abs(x) * math.sqrt((k - 2) / max(1e-300, (1 - x) * (1 + x))) if abs(x) < 1 else math.inf, k - 2) for x, k in zip(rs, ns)], dtype="float64")

    return tail(F.col(r).cast("double"), F.col(n).cast("bigint"))


@F.pandas_udf(DoubleType())
def round_half_even(v: pd.Series, places: pd.Series) -> pd.Series:
    """Rounding of the binary value, ties to even, as in correct decimal rounding of floats."""
    return pd.Series([None if x is None or x != x else round(float(x), int(k)) for x, k in zip(v, places)], dtype="float64")


def with_overall(df: DataFrame, subset: str) -> DataFrame:
    """Every row once under its subset and once under 'Overall' (null subsets count only there)."""
    return df.withColumn(subset, F.explode(F.array_compact(F.array(F.lit("Overall"), F.col(subset)))))


def correlations(pairs: DataFrame, measures: tuple[str, ...], subset: Column, track: str) -> DataFrame:
    """Long correlation table: track, subset, measure, n, mean_auto, mean_manual, pearson_r, pearson_p, spearman_rho,
    spearman_p, icc_2_1, bias, mae. pairs: columns <measure>_auto and <measure>_manual."""
    long = pairs.select(subset.alias("subset"), F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{m}_auto").alias("a"), F.col(f"{m}_manual").alias("b")) for m in measures])).alias("x")).select("subset", "x.*")
    by = ["subset", "measure"]
    long = written(with_overall(long, "subset").filter("a is not null and b is not null"), "pairs")
    plain = _by(long, by, F.avg("a").alias("mean_auto"), F.avg("b").alias("mean_manual"), _r("a", "b").alias("pearson_r"), F.avg(F.col("a") - F.col("b")).alias("bias"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"))
    out = plain.join(icc_2_1(long, by), by).join(spearman(long, by).drop("n"), by)
    return out.select(F.lit(track).alias("track"), *by, "n", "mean_auto", "mean_manual", "pearson_r", p_value("pearson_r", "n").alias("pearson_p"), "spearman_rho", p_value("spearman_rho", "n").alias("spearman_p"), "icc_2_1", "bias", "mae")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight: rows / (classes x n)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total, classes = c.agg(F.sum("n")).scalar(), c.agg(F.count(F.lit(1))).scalar()
    return c.select(label, "n", (total / (classes * F.greatest("n", F.lit(1)))).alias("weight"))
