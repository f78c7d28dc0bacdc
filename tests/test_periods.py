import random

import pytest

from conftest import rows
from speechloom.operators.periods import merge_periods, periods_and_holes, unpivot_spans

SCHEMA = "k string, begin bigint, finish bigint"


def brute(spans):
    out = []
    for b, f in sorted(set(spans)):
        if out and b <= out[-1][1]:
            out[-1][1], out[-1][2] = max(out[-1][1], f), True
        else:
            out.append([b, f, False])
    return out


@pytest.mark.parametrize("bucket", [7, 50, 1_200_000])
def test_against_brute_force(spark, bucket):
    rng = random.Random(bucket)
    data = [(f"k{rng.randrange(12)}", b := rng.randrange(-300, 300), b + rng.choice([1, 2, 5, 20, 90])) for _ in range(500)]
    data += data[:40]
    want = []
    for k in {d[0] for d in data}:
        p = brute([d[1:] for d in data if d[0] == k])
        want += [(k, "period", b, f, s) for b, f, s in p] + [(k, "hole", a[1], b[0], None) for a, b in zip(p, p[1:])]
    got = rows(periods_and_holes(spark.createDataFrame(data, SCHEMA), ["k"], None, bucket))
    assert got == sorted(want, key=repr)


def test_touching_across_a_bucket_edge_is_one_period(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 21, 40)], SCHEMA)
    assert rows(periods_and_holes(df, ["k"], None, 10)) == [("a", "hole", 20, 21, None), ("a", "period", 0, 20, True), ("a", "period", 21, 40, False)]


def test_longest_hole(spark):
    df = spark.createDataFrame([("a", 0, 1), ("a", 5, 6), ("a", 100, 101)], SCHEMA)
    assert [r[2:4] for r in rows(periods_and_holes(df, ["k"], 10)) if r[1] == "hole"] == [(1, 5)]


def test_nulls_repeats_empty_and_further_columns(spark):
    df = spark.createDataFrame([(None, 0, 5), (None, 3, 9), ("a", None, 5), ("a", 1, None), ("a", 5, 5), ("a", 9, 2), ("a", 1, 2), ("a", 1, 2)], SCHEMA)
    df = df.selectExpr("*", "1 as several", "'x' as kind", "2 as last_begin")
    assert rows(merge_periods(df, ["k"])) == [("a", 1, 2, False), (None, 0, 9, True)]
    assert rows(periods_and_holes(df.limit(0), ["k"])) == []


def test_times_not_given(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", nan, 2.0), ("a", 1.0, None), ("a", 3.0, 2.0), ("a", 1.0, float("inf")), ("a", 2e9, 2e9 + 5)], "k string, x double, y double")
    assert rows(unpivot_spans(df, ["k"], {"f": ("x", "y")})) == [("a", "f", 10_000, 20_000), ("a", "f", 20_000_000_000_000, 20_000_000_050_000)]


@pytest.mark.parametrize("bucket", [3, 10])
def test_intervals_over_many_buckets_against_brute_force(spark, bucket):
    rng = random.Random(bucket)
    data = [(f"k{rng.randrange(40)}", b := rng.randrange(-200, 900), b + rng.choice([1, 2, 3, bucket, 4 * bucket, 17 * bucket, 200])) for _ in range(400)]
    data += [(None, *d[1:]) for d in data[:12]]
    want = []
    for k in {d[0] for d in data}:
        p = brute([d[1:] for d in data if d[0] == k])
        want += [(k, "period", b, f, s) for b, f, s in p] + [(k, "hole", a[1], b[0], None) for a, b in zip(p, p[1:])]
    assert rows(periods_and_holes(spark.createDataFrame(data, SCHEMA), ["k"], None, bucket)) == sorted(want, key=repr)


def test_an_interval_of_any_length_is_cheap(spark):
    df = spark.createDataFrame([("a", 0, 10**16), ("a", 5 * 10**15, 5 * 10**15 + 3), ("a", 10**16 + 5, 10**16 + 6)], SCHEMA)
    assert rows(periods_and_holes(df, ["k"])) == [("a", "hole", 10**16, 10**16 + 5, None), ("a", "period", 0, 10**16, True), ("a", "period", 10**16 + 5, 10**16 + 6, False)]
