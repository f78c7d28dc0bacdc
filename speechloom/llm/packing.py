"""Filling containers of fixed capacity with items, splitting only what is larger than a container.

Method. Best-fit decreasing: items in decreasing size go to the open container with the least room that still takes
them, found in a segment tree over remaining capacities in logarithmic time. A larger item is cut into full pieces and
a rest, which is packed like an item.

There are at most `capacity` sizes, so the whole packing is decided on how many items of each size there are: items of
one size are interchangeable, and runs of containers with the same room are taken from the tree at once. The result is
that of one packing of everything, whatever the input's files and partitions. It says where the r-th item of each size
goes; items take their rank in their size from counts per (size, hash bucket), so no size is ordered in one task. Only
counts per size (at most `capacity` rows) reach the driver, and only ids, sizes and places leave the operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.session import shuffle_partitions, small_table, written

CAPACITY = 1_024
#: Copies of one (key, size) that are worked on as one row.
COPIES = 65_536
_RANK_BITS = 44

#: The token rule \w+|[^\w\s]+ with the Unicode meaning of \w (letters, numbers, underscore) and \s.
_SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]+"


def count_tokens(text: Column) -> Column:
    """Tokens of a text as BIGINT; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


class Room:
    """Segment tree over remaining capacities 0...capacity: the runs of open containers that have each."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, first: int, n: int) -> None:
        self.open[room].append((first, n))
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int, int] | None:
        """(room, first container, containers) of a run with the least room for size, which is removed; None if there
        is none."""
        i = size + self.leaves
        if not self.count[i]:
            # Up until a right sibling holds a run, then down to its leftmost one.
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, *self.open[room].pop()


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(size, rank, container, per): from this rank on the items of a size go to containers from this one on, `per` to
    each. counts: items of each size, 0 < size <= capacity. In order of size and rank.

    A container that took an item has less room than before, so it stays the tightest while it takes one more: a run of
    containers with room r takes r // size items each."""
    places, fresh, room = [], 0, Room(capacity)
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            if (hit := room.take(size)) is None:
                free, first, n = capacity, fresh, -(-left // (capacity // size))
                fresh += n
            else:
                free, first, n = hit
            per = free // size
            for run, each in ((min(n, left // per), per), (1, left % per if left < n * per else 0)):
                if run and each:
                    places.append((size, rank, first, each))
                    if rest := free - each * size:
                        room.add(rest, first, run)
                    first, n, rank, left = first + run, n - run, rank + run * each, left - run * each
            if n:
                room.add(free, first, n)
    return sorted(places)


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of items in containers: key, piece (from 0), offset and length (tokens), container.

    items: key (any type that can be grouped by), size BIGINT; further columns are ignored. Only items larger than
    capacity have more than one piece. Null, zero and negative sizes take no room and get no piece; rows with a null or
    repeated key are packed one by one; an empty table gives an empty result. Sizes are counted when this is called."""
    buckets = shuffle_partitions(items.sparkSession)
    sized = items.select(F.col(key).alias("_key"), F.col(size).cast("bigint").alias("_size")).filter("_size > 0").groupBy("_key", "_size").agg(F.count(F.lit(1)).alias("_n"))
    sized = written(sized, "sizes").withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {COPIES}"))))
    sized = sized.withColumn("_n", F.least(F.lit(COPIES), F.col("_n") - F.col("_c") * COPIES)).withColumn("_bucket", F.pmod(F.xxhash64("_key", "_size", "_c"), F.lit(buckets)))
    # An item's full pieces, and its rest.
    full, rest = F.expr(f"_size div {capacity}"), F.col("_size") % capacity
    kinds = F.array(F.struct(F.lit(capacity).cast("bigint").alias("length"), full.alias("units"), F.lit(0).cast("bigint").alias("first")), F.struct(rest.alias("length"), (rest > 0).cast("bigint").alias("units"), full.alias("first")))
    runs = sized.withColumn("_r", F.explode(F.filter(kinds, lambda x: x["units"] > 0))).select("_key", "_size", "_c", "_bucket", "_r.*", (F.col("_n") * F.col("_r.units")).alias("_w"))
    cells = runs.groupBy("length", "_bucket").agg(F.sum("_w").alias("_t"))
    until = lambda *by: Window.partitionBy("length", *by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, 0)
    bases = cells.select("length", "_bucket", (F.sum("_t").over(until(["_bucket"])) - F.col("_t")).alias("_base"))
    counts = {r["length"]: r["n"] for r in small_table(cells.groupBy("length").agg(F.sum("_t").alias("n")), capacity)}
    places = np.array(best_fit_decreasing(counts, capacity), np.int64).reshape(-1, 4)

    @F.pandas_udf("bigint")
    def container(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        starts = (places[:, 0] << _RANK_BITS) | places[:, 1]
        for lengths, ranks in it:
            s, r = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64)
            at = places[np.searchsorted(starts, (s << _RANK_BITS) | r, "right") - 1]
            yield pd.Series(at[:, 2] + (r - at[:, 1]) // at[:, 3])

    ranked = runs.withColumn("_start", F.sum("_w").over(until("_bucket", ["_size", "_key", "_c"])) - F.col("_w")).join(bases, ["length", "_bucket"])
    each = ranked.withColumn("_u", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_w") - 1)))
    piece = F.col("first") + F.col("_u") % F.col("units")
    return each.select(F.col("_key").alias(key), piece.cast("int").alias("piece"), (piece * capacity).alias("offset"), "length", container("length", F.col("_base") + F.col("_start") + F.col("_u")).alias("container"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pack of documents (doc_id, text) sized by the token rule; each text is counted whole, n_tokens is not trusted."""
    return pack(documents.select("doc_id", count_tokens(F.col("text")).alias("size")), "doc_id", "size", capacity)
