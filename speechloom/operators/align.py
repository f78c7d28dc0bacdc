"""Sequence alignment and matching in order: edit alignment, greedy time matches, aligner map-back, timeline repair.

These depend on the rows before in ways windows can't express. Each works on one sequence pair (a recording), handed to
Python as Arrow batches; sequences are bounded by a recording. Nothing is shuffled where both sequences lie in one row.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.operators import intervals as I

ALIGNED = "array<struct<ref_idx:int,hyp_idx:int,op:string>>"


def edit_path(ref: list, hyp: list) -> list[tuple[int | None, int | None, str]]:
    """Cheapest alignment (unit costs) read from the end, preferring match, then substitution, deletion, insertion."""
    n, m = len(ref), len(hyp)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys([*ref, *hyp]))}
    r, h = np.array([vocabulary[w] for w in ref], np.int64), np.array([vocabulary[w] for w in hyp], np.int64)
    cost = np.empty((n + 1, m + 1), np.int32)
    cost[0] = steps = np.arange(m + 1)
    for i in range(1, n + 1):
        # Without insertions first; those then come along the row as a running minimum of cost less position.
        row = np.minimum(cost[i - 1] + 1, np.concatenate(([i], cost[i - 1, :-1] + (h != r[i - 1]))))
        cost[i] = np.minimum.accumulate(row - steps) + steps
    path, i, j = [], n, m
    while i or j:
        here = cost[i, j]
        if i and j and cost[i - 1, j - 1] + (r[i - 1] != h[j - 1]) == here:
            i, j = i - 1, j - 1
            path.append((i, j, "C" if r[i] == h[j] else "S"))
        elif i and cost[i - 1, j] + 1 == here:
            i -= 1
            path.append((i, None, "D"))
        else:
            j -= 1
            path.append((None, j, "I"))
    return path[::-1]


def edit_align(ref: Column, hyp: Column) -> Column:
    """edit_path of two ARRAY<STRING> columns as ARRAY<STRUCT<ref_idx, hyp_idx, op>>; null arrays count as empty."""

    @F.pandas_udf(ALIGNED)
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in it:
            yield pd.Series([[{"ref_idx": x, "hyp_idx": y, "op": o} for x, y, o in edit_path(list(r) if r is not None else [], list(h) if h is not None else [])] for r, h in zip(a, b)])

    return run(ref, hyp)


def word_error_rate(aligned: Column, ref: Column) -> Column:
    return F.size(F.filter(aligned, lambda x: x["op"] != "C")) / F.greatest(F.size(ref), F.lit(1))


def segment_starts(segments: Column) -> Column:
    """Positions of the words that begin a segment, the first segment's left out, of ARRAY<ARRAY<STRING>>."""
    sizes = F.transform(segments, F.size)
    sums = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    return F.array_distinct(F.filter(F.slice(sums, 1, F.greatest(F.size(sums) - 1, F.lit(0))), lambda p: p > 0))


def boundary_pairs(df: DataFrame, keys: list[str], canonical: str, gold: str, auto: str) -> DataFrame:
    """Boundary labels at each place of the alignment of canonical words and auto words: keys, op, gold, auto.

    canonical ARRAY<STRING>; gold and auto ARRAY<ARRAY<STRING>> (segments of words). Gold labels are carried to the
    canonical words by alignment; a word without a partner has no boundary on the other side."""
    flat = df.select(*keys, F.col(canonical).alias("c"), F.flatten(gold).alias("gw"), segment_starts(F.col(gold)).alias("gb"), F.flatten(auto).alias("aw"), segment_starts(F.col(auto)).alias("ab"))
    carried = F.transform(F.filter(edit_align(F.col("gw"), F.col("c")), lambda x: x["op"].isin("C", "S") & F.array_contains(F.col("gb"), x["ref_idx"])), lambda x: x["hyp_idx"])
    flat = flat.withColumn("cb", carried).withColumn("x", F.explode(edit_align(F.col("c"), F.col("aw"))))
    has = lambda a, i: F.coalesce(F.array_contains(F.col(a), F.col(i)), F.lit(False))
    return flat.select(*keys, F.col("x.op").alias("op"), has("cb", "x.ref_idx").alias("gold"), has("ab", "x.hyp_idx").alias("auto"))


def segments_to_time(df: DataFrame, keys: list[str], gold: str, words: str) -> DataFrame:
    """Time of each gold segment by its first and last word that has an aligned spoken word: keys, idx, s, e.

    gold ARRAY<ARRAY<STRING>>; words ARRAY<STRUCT<word, s, e>> in order. Segments without an aligned word are left out."""
    d = df.select(*keys, F.col(words).alias("w"), F.flatten(gold).alias("g"), F.flatten(F.transform(gold, lambda s, i: F.transform(s, lambda _: i))).alias("seg"))
    d = d.withColumn("x", F.explode(F.filter(edit_align(F.col("g"), F.transform("w", lambda x: x["word"])), lambda x: x["op"].isin("C", "S"))))
    at = d.select(*keys, F.get("seg", F.col("x.ref_idx")).alias("idx"), F.col("x.ref_idx").alias("r"), F.get("w", F.col("x.hyp_idx")).alias("w"))
    return at.groupBy(*keys, "idx").agg(F.min_by("w.s", "r").alias("s"), F.max_by("w.e", "r").alias("e"))


def _per_group(df: DataFrame, keys: list[str], fn: Callable[[list[dict]], list[dict]], columns: list[str], out: str) -> DataFrame:
    """fn over the rows of each group as an array of structs, result exploded; a group lies in one row."""
    g = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_rows"))

    @F.pandas_udf(f"array<struct<{out}>>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([fn([r if isinstance(r, dict) else r.asDict() for r in rows]) for rows in s])

    return g.select(*keys, F.explode(run("_rows")).alias("_x")).select(*keys, "_x.*")


def greedy_matches(gold: DataFrame, pred: DataFrame, keys: list[str], window: float = 2.0) -> DataFrame:
    """One-to-one matches of equal tokens in gold order, each to the nearest unused start less than window away: keys,
    g_idx, p_idx, start_error, end_error. gold, pred: keys, idx, s, e, token.

    Tokens match only their like, and never over a stretch of at least window in which none of them begins: each such
    run of (keys, token) is worked on alone, so a task holds as many rows as one token has without such a rest."""
    side = lambda df, k: df.select(*keys, "token", F.lit(k).alias("side"), F.col("idx").cast("bigint").alias("idx"), "s", "e")
    both = side(gold, 0).unionByName(side(pred, 1)).filter("token <> '' and s is not null and not isnan(s)")
    by, order = [*keys, "token"], ["s", "side", "idx"]
    both = I.along(both, by, I.time_block(), order, _p=("lag", "s"))
    both = I._runs(both, by, I.time_block(), order, F.coalesce(F.col("s") - F.col("_p") >= window, F.lit(True)))

    def match(rows: list[dict]) -> list[dict]:
        pred = sorted((r for r in rows if r["side"]), key=lambda r: (r["s"], r["idx"]))
        starts, used, out = [p["s"] for p in pred], [False] * len(pred), []
        for g in (r for r in rows if not r["side"]):
            near = range(bisect_left(starts, g["s"] - window), bisect_right(starts, g["s"] + window))
            best = min(((abs(g["s"] - starts[k]), pred[k]["idx"], k) for k in near if not used[k]), default=(window, 0, 0))
            if best[0] < window:
                k = best[2]
                used[k] = True
                out.append({"g_idx": g["idx"], "p_idx": pred[k]["idx"], "start_error": best[0], "end_error": abs(g["e"] - pred[k]["e"])})
        return out

    return _per_group(both, [*by, "_run"], match, ["side", "idx", "s", "e"], "g_idx:bigint,p_idx:bigint,start_error:double,end_error:double").drop("_run", "token")


def map_back(expected: list[str], heard: list[str], joins: int = 1) -> list[tuple[int, int] | None]:
    """Span of heard tokens of each expected token, in one forward pass.

    joins > 1: an expected token may be up to so many heard tokens joined. A token not found from the current place on
    has no span; without joins the pass then has run off its end, with joins it stays where it was."""
    places: dict[str, deque[int]] = defaultdict(deque)
    for i, t in enumerate(heard):
        places[t].append(i)
    out: list[tuple[int, int] | None] = []
    at = 0
    for t in expected:
        if at >= len(heard):
            out.append(None)
            continue
        if joins > 1 and heard[at] != t:
            n = next((n for n in range(2, joins + 1) if at + n <= len(heard) and "".join(heard[at : at + n]) == t), 0)
            if n:
                out.append((at, at + n))
                at += n
                continue
        later = places[t]
        while later and later[0] < at:
            later.popleft()
        if later:
            out.append((later[0], later[0] + 1))
            at = later[0] + 1
        else:
            out.append(None)
            at = at if joins > 1 else len(heard)
    return out


def aligner_times(words: DataFrame, heard: DataFrame, keys: list[str], joins: int = 1) -> DataFrame:
    """Words with the aligner's times where their token is found, else their rough ones (at least 1 ms long): keys,
    idx, word, start, end, source ('mfa', 'rough').

    words: keys, idx, sub, token, word, s, e in the order (idx, sub); word null: a filler put in, which takes up what
    it matches and gives no row. heard: keys, idx, token, s, e."""
    both = words.select(*keys, F.lit(0).alias("side"), "idx", "sub", "token", "word", "s", "e").unionByName(
        heard.select(*keys, F.lit(1).alias("side"), "idx", F.lit(0).alias("sub"), "token", F.lit(None).cast("string").alias("word"), "s", "e"))

    def run(rows: list[dict]) -> list[dict]:
        asked, got = [r for r in rows if not r["side"]], [r for r in rows if r["side"]]
        fold = (lambda t: t.lower()) if joins > 1 else (lambda t: t)
        has_token = [r for r in asked if r["token"]]
        spans = dict(zip(map(id, has_token), map_back([fold(r["token"]) for r in has_token], [fold(r["token"]) for r in got], joins)))
        out = []
        for r in asked:
            if r["word"] is None:
                continue
            if span := spans.get(id(r)):
                s, e, source = got[span[0]]["s"], got[span[1] - 1]["e"], "mfa"
            else:
                s, e, source = r["s"], r["e"] if r["e"] > r["s"] else r["s"] + 0.001, "rough"
            out.append({"idx": r["idx"], "word": r["word"], "start": round(s, 3), "end": round(e, 3), "source": source})
        return out

    return _per_group(both, keys, run, ["side", "idx", "sub", "token", "word", "s", "e"], "idx:int,word:string,start:double,end:double,source:string")


def repair_timeline(words: Column, duration: Column, least: float = 0.001) -> Column:
    """Words (ARRAY<STRUCT<s, e, label>>, in order) as a gapless tier: none starts before the one before ended, each
    lasts at least `least`, holes longer than 1 ms and the rest up to duration become blanks."""
    point = lambda s, e, lab: F.struct(s.cast("double").alias("s"), e.cast("double").alias("e"), lab.alias("label"))
    empty = F.expr("cast(array() as array<struct<s:double,e:double,label:string>>)")

    def step(acc: Column, w: Column) -> Column:
        end = F.when(w["e"] <= w["s"], w["s"] + least).otherwise(w["e"])
        start = F.greatest(w["s"], acc["end"])
        end = F.when(end <= start, start + least).otherwise(end)
        hole = F.when(start > acc["end"] + 0.001, F.array(point(acc["end"], start, F.lit("")))).otherwise(empty)
        return F.struct(end.alias("end"), F.concat(acc["tier"], hole, F.array(point(start, end, w["label"]))).alias("tier"))

    done = F.aggregate(F.filter(words, lambda w: w["label"] != ""), F.struct(F.lit(0.0).alias("end"), empty.alias("tier")), step)
    return F.concat(done["tier"], F.when(done["end"] < duration, F.array(point(done["end"], duration, F.lit("")))).otherwise(empty))


def split_by_length(parts: Column, s: Column, e: Column) -> Column:
    """Pieces of a token with its time shared out by length: ARRAY<STRUCT<word, s, e>> of ARRAY<STRING>."""
    total = F.aggregate(parts, F.lit(0), lambda a, p: a + F.length(p))
    before = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p))))
    at = lambda n: s + (e - s) * n / F.when(total > 0, total)
    return F.transform(parts, lambda p, i: F.struct(p.alias("word"), at(F.get(before, i)).alias("s"), at(F.get(before, i + 1)).alias("e")))


def retokenise(words: DataFrame, keys: list[str], tokenise: Callable[[str], list[str]]) -> DataFrame:
    """Words re-cut by a tokeniser: keys, idx, sub, word, s, e. Kept whole where the pieces don't join to the word;
    null words are left out. tokenise runs in Arrow batches on the executors."""

    @F.pandas_udf("array<string>")
    def pieces(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series([[p for p in tokenise(w) if p.strip()] if w else [] for w in s])

    p = words.filter("word is not null").withColumn("_p", pieces("word")).withColumn("_p", F.when((F.size("_p") > 1) & (F.concat_ws("", "_p") == F.col("word")), F.col("_p")).otherwise(F.array("word")))
    return p.select(*keys, "idx", F.posexplode(split_by_length(F.col("_p"), F.col("s"), F.col("e"))).alias("sub", "x")).select(*keys, "idx", "sub", "x.*")


def lead_gap(words: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys, idx, s, e) with gap, the time to the next word (null at the end)."""
    return I.along(words, keys, I.row_block("idx"), ["idx"], _next=("lead", "s")).withColumn("gap", F.col("_next") - F.col("e")).drop("_next")


def gaps_with_edges(words: DataFrame, keys: list[str], bounds: DataFrame) -> DataFrame:
    """Gaps of a key: keys, place ('leading', 'between', 'trailing'), gap. From low to the first word, between words in
    order of idx, from the last word to high. words: keys, idx, s, e; bounds: keys, low, high; keys without words: no gap."""
    between = lead_gap(words, keys).filter("gap is not null").select(*keys, F.lit("between").alias("place"), "gap")
    ends = words.groupBy(*keys).agg(F.min_by("s", "idx").alias("_f"), F.max_by("e", "idx").alias("_l")).join(bounds, keys)
    edge = F.array(F.struct(F.lit("leading").alias("place"), (F.col("_f") - F.col("low")).alias("gap")), F.struct(F.lit("trailing").alias("place"), (F.col("high") - F.col("_l")).alias("gap")))
    return between.unionByName(ends.select(*keys, F.explode(edge).alias("x")).select(*keys, "x.*"))
