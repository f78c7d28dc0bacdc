import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from speechloom.llm.nearest import nearest_in_time, point_ref, word_points

L = "k string, t bigint, id int"
R = "k string, ts array<struct<t:bigint,ref:bigint>>"


def brute(left, right, tol):
    out = set()
    for k, t, i in left:
        near = [(abs(t - p), r) for kk, ps in right if ps is not None for p, r in ps if kk == k is not None and t is not None and p is not None and r is not None and abs(t - p) <= tol]
        if near:
            out.add((k, t, i, *min(near)))
    return out


@pytest.mark.parametrize("tol,first,block", [(100, 7, 50), (100, 100, 1000), (40, 3, 17)])
def test_against_brute_force(spark, tol, first, block):
    rng = random.Random(tol * first)
    left = [(rng.choice("abc"), rng.randrange(-500, 2000), i) for i in range(200)]
    right = [(rng.choice("abcd"), [(rng.randrange(-500, 2000), rng.randrange(50)) for _ in range(rng.randrange(6))]) for _ in range(60)]
    got = nearest_in_time(spark.createDataFrame(left, L), spark.createDataFrame(right, R), "k", tol, first, block)
    assert {tuple(r) for r in got.collect()} == brute(left, right, tol) and got.count() == len({tuple(r) for r in got.collect()})


def test_edges_ties_and_nulls(spark):
    left = [("a", 0, 1), ("a", 0, 1), ("a", 1000, 2), (None, 0, 3), ("a", None, 4), ("b", 0, 5)]
    right = [("a", [(100, 5), (-100, 3), (100, 2), (None, 1), (50, None)]), ("a", [(1101, 1)]), (None, [(0, 1)]), ("b", None), ("b", [])]
    got = nearest_in_time(spark.createDataFrame(left, L), spark.createDataFrame(right, R), "k", 100, 10, 300)
    assert rows(got) == [("a", 0, 1, 100, 2)]


def test_empty_and_further_columns(spark):
    left = spark.createDataFrame([("a", 5, 1)], L).selectExpr("*", "1 as ref", "'x' as distance", "3 as ts")
    right = spark.createDataFrame([("a", [(6, 9)])], R).selectExpr("*", "1 as id", "2 as distance")
    assert rows(nearest_in_time(left, right, "k")) == [("a", 5, 1, 3, 1, 9)]
    assert nearest_in_time(left, right.limit(0), "k").count() == 0 and nearest_in_time(left.limit(0), right, "k").count() == 0


def test_hot_copies(spark):
    left = spark.range(3000).select(F.lit("a").alias("k"), F.lit(7).cast("bigint").alias("t"), F.lit(1).alias("id"))
    right = spark.createDataFrame([("a", [(8, 2)])] * 500, R)
    assert rows(nearest_in_time(left, right, "k")) == [("a", 7, 1, 1, 2)]


def test_word_points(spark):
    nan = float("nan")
    w = [("hi", 1.0, 2.0, None), (" 　", 1.0, 2.0, None), (None, 1.0, 2.0, None), ("x", nan, 2.0, None), ("y", 2.0, 2.0, None), ("z", 3.0, 3.5, "mfa")]
    d = spark.createDataFrame([("f", 2, w), ("g", 0, None)], "file_id string, chunk_no int, words array<struct<word:string,start:double,end:double,source:string>>")
    ref = spark.range(1).select(point_ref(F.lit(2), F.lit(0)), point_ref(F.lit(2), F.lit(5))).first()
    got = {r.file_id: r.ts for r in word_points(d).collect()}
    assert [tuple(p) for p in got["f"]] == [(10_000, ref[0]), (20_000, ref[0]), (30_000, ref[1]), (35_000, ref[1])] and got["g"] is None
