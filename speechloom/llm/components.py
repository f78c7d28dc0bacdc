"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.session import forget, read_back, write_shared


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _tidy(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return _tidy(edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))


def connected_components(edges: DataFrame) -> DataFrame:
    """Component of each node that has a link: node, component (the component's least node).

    edges: u, v BIGINT; order, repeats and self-links don't matter, rows with a null are left out. A node with self-links
    only is not listed. Rounds grow with the logarithm of a component's size. Every round's links are written to the
    shared folder and the round's before removed, so plans stay short and a lost executor costs no earlier round; a node's links to its least neighbour are found by
    aggregation and join, so no node's links are gathered in a task.
    """
    spark = edges.sparkSession
    first = _tidy(edges.filter("u is not null and v is not null"))
    path = write_shared(first, "links")
    told = None
    while True:
        now = read_back(first, path)
        after = write_shared(_small_star(_large_star(now)), "links")
        forget(spark, path)
        path = after
        # Unchanged links mean stars: the count and the sums of their ends stay the same only then.
        state = read_back(first, path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if told == state:
            break
        told = state
    stars = read_back(first, path)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
