import random

from conftest import rows
from pyspark.sql import functions as F
from speechloom.functions import text as T
from speechloom.operators import intervals as I

S = "k string, s double, e double"


def df(spark, *spans, schema=S):
    return spark.createDataFrame([("a", *map(float, s[:2]), *s[2:]) for s in spans], schema)


def se(d):
    return [(round(r.s, 6), round(r.e, 6)) for r in d.orderBy("s").collect()]


def test_merge(spark):
    assert se(I.merge(df(spark, (0, 1), (1.02, 1.5), (1.1, 1.2), (1.6, 2), (2.5, 3)), ["k"], 0.03)) == [(0, 1.5), (1.6, 2), (2.5, 3)]
    nested = df(spark, (0, 10), (1, 2), (5, 6), (9, 12), (3, 1))
    assert se(I.merge(nested, ["k"])) == [(0, 12)]
    once = I.merge(nested, ["k"])
    assert se(I.merge(once, ["k"])) == se(once)


def test_merge_in_blocks_is_the_same(spark):
    rng = random.Random(8)
    v = [(rng.choice(["a", "b", None]), x := rng.randrange(0, 4000) / 10, x + rng.choice([0.1, 1, 5, 80])) for _ in range(400)]
    d = spark.createDataFrame(v, S)
    for gap in (0.0, 0.35, 3.0):
        want = rows(I.merge(d, ["k"], gap))
        for split in (0.7, 5.0, 60.0, 1e4):
            assert rows(I.merge(d, ["k"], gap, split)) == want


def test_merge_last_end_keeps_the_last_end(spark):
    d = spark.createDataFrame([("a", 0, 10), ("a", 2, 4), ("a", 5, 6), ("a", 50, 51)], "k string, s bigint, e bigint")
    assert rows(I.merge_last_end(d, ["k"], 3)) == [("a", 0, 6), ("a", 50, 51)]


def test_gaps(spark):
    length = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "k string, duration double")
    assert rows(I.gaps(df(spark, (0.5, 1), (1.1, 2)), ["k"], 0.12, 0.0, length)) == [("a", 0.0, 0.5), ("a", 2.0, 3.0), ("b", 0.0, 1.0)]
    n = I.numbered_gaps(df(spark, (0.5, 1), (4, 5), (5.5, 6)), ["k"], 0.12, 1.2)
    assert [(r.gap_index, r.s) for r in n.orderBy("s").collect()] == [(0, 0.0), (2, 5.0)]


def test_subtract(spark):
    got = I.subtract(df(spark, (0, 2), (4, 4.1)), df(spark, (0.1, 0.4), (1, 1.5)), ["k"], 0.25)
    assert se(got) == [(0.4, 1), (1.5, 2), (4, 4.1)]
    assert se(I.subtract(df(spark, (1, 1.4)), df(spark, (0.9, 1.5)), ["k"], 0.25)) == []


def test_parts_and_overlaps_make_the_pause(spark):
    rng = random.Random(4)
    p = [(k, x := rng.randrange(0, 900) / 10, x + rng.randrange(1, 400) / 10) for k in "abcdef" for _ in range(3)]
    i = [(k, x := rng.randrange(0, 900) / 10, x + rng.randrange(1, 30) / 10) for k in "abcdef" for _ in range(12)]
    pd, idf = spark.createDataFrame(p, S), I.merge(spark.createDataFrame(i, S), ["k"])
    parts = I.subtract(pd, idf, ["k"], 1e-9, 0.0).groupBy("k", "p_s", "p_e").agg(F.sum(F.col("e") - F.col("s")).alias("left"))
    cut = I.overlaps(pd.distinct(), idf, ["k"]).groupBy("k", F.col("a_s").alias("p_s"), F.col("a_e").alias("p_e")).agg(F.sum(F.col("o_e") - F.col("o_s")).alias("gone"))
    for r in parts.join(cut, ["k", "p_s", "p_e"], "full").fillna(0).collect():
        assert abs(r.left + r.gone - (r.p_e - r.p_s)) < 1e-9


def test_overlaps_do_not_depend_on_bins(spark):
    rng = random.Random(5)
    one = [(k, x := rng.random() * 100, x + rng.random() * 40) for k in "ab" for _ in range(40)]
    two = [(k, x := rng.random() * 100, x + rng.random() * 5) for k in "ab" for _ in range(40)]
    a, b = spark.createDataFrame(one, S), spark.createDataFrame(two, S)
    want = sorted((x[0], max(x[1], y[1]), min(x[2], y[2])) for x in one for y in two if x[0] == y[0] and min(x[2], y[2]) > max(x[1], y[1]))
    for w in (3.0, 30.0, 1000.0):
        assert sorted((r.k, r.o_s, r.o_e) for r in I.overlaps(a, b, ["k"], w).collect()) == want


def test_classify(spark):
    c = df(spark, (0, 6, 0), (4, 5.05, 1), schema=S + ", o int")
    got = I.classify(df(spark, (5, 6), (9, 10), (5.9, 6.5)), c, ["k"], "o")
    assert [(r.s, r.location) for r in got.orderBy("s").collect()] == [(5.0, "mid"), (5.9, "end"), (9.0, "end")]
    assert I.classify(df(spark, (5, 6)), c.limit(0), ["k"], "o").first().location == "end"


def test_runs(spark):
    d = spark.createDataFrame([("a", i, u, p, x) for i, (u, p, x) in enumerate([(3, False, 0.3), (0, True, 0.2), (2, False, 0.3), (0, True, 0.3), (0, False, 0.1), (0, True, 0.5), (4, False, 0.1)])], "k string, i int, u int, p boolean, d double")
    assert sorted(r.units for r in I.run_units(d, ["k"], "i", F.col("p") & (F.col("d") >= 0.25), F.col("u")).collect()) == [4, 5]


def test_patch_and_coalesce(spark):
    t = df(spark, (0, 1, "hi"), (1, 3, ""), (3, 4, "yo"), schema=S + ", label string")
    got = I.patch(t, df(spark, (1.5, 2), (2.01, 2.2), (3.2, 3.5)), ["k"], T.is_pause(F.col("label")), "<f>")
    assert [(r.s, r.e, r.label) for r in got.orderBy("s").collect()] == [(0, 1, "hi"), (1, 1.5, ""), (1.5, 2.2, "<f>"), (2.2, 3, ""), (3, 4, "yo")]
    same = df(spark, (0, 1, "a"), (1, 2, "a"), (2.5, 3, "a"), schema=S + ", label string")
    assert se(I.coalesce_equal(same, ["k"])) == [(0, 2), (2.5, 3)]


def test_timeline(spark):
    t = df(spark, (-1, 2, "a"), (1, 3, "b"), (2, 2.5, "c"), (5, 99, "d"), schema=S + ", label string").unionByName(spark.createDataFrame([("a", None, 4.0, "x")], S + ", label string"))
    b = spark.createDataFrame([("a", 0.0, 10.0), ("z", 0.0, 1.0)], "k string, low double, high double")
    assert rows(I.fill_timeline(t, ["k"], b)) == sorted([("a", 0.0, 2.0, "a"), ("a", 2.0, 3.0, "b"), ("a", 3.0, 5.0, ""), ("a", 5.0, 10.0, "d"), ("z", 0.0, 1.0, "")], key=repr)


def test_blank_outside(spark):
    t = df(spark, (0, 1, "a"), (1.5, 2.5, "b"), (2.5, 3, "c"), schema=S + ", label string")
    span = spark.createDataFrame([("a", 2.0, None)], "k string, first double, last double")
    assert [r.label for r in I.blank_outside(t, ["k"], span).orderBy("s").collect()] == ["", "", "c"]


def test_contained_count(spark):
    w, p = df(spark, (0, 1), (1, 2)), df(spark, (0, 0.5, "AH0"), (0.5, 1, "T"), (0.9, 1.1, "AE1"), (1.2, 1.4, "IY"), schema=S + ", label string")
    assert [r.n for r in I.contained_count(w, p, ["k"], T.is_vowel_phone(F.col("label"))).orderBy("s").collect()] == [1, 1]


def test_empty(spark):
    e = spark.createDataFrame([], S)
    for out in (I.merge(e, ["k"]), I.gaps(e, ["k"], 0.1), I.overlaps(e, e, ["k"]), I.subtract(e, e, ["k"], 0.2)):
        assert out.count() == 0


def test_times_not_given(spark):
    nan = float("nan")
    d = spark.createDataFrame([("a", 0.0, nan), ("a", nan, 1.0), ("a", None, 1.0), ("a", 1.0, None), ("a", 2.0, 3.0)], S)
    assert se(I.merge(d, ["k"])) == se(I.merge(d, ["k"], 0.0, 5.0)) == [(2, 3)]
    assert I.overlaps(d, d, ["k"]).count() == 1 and se(I.gaps(d, ["k"], 0.5)) == [(0, 2)]
    assert I.classify(d, d.selectExpr("*", "1 as o"), ["k"], "o").count() == 5
