import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from speechloom.operators import align as L


def cost(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_edit_path_costs_least_and_covers_both():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(2))
        p = L.edit_path(a, b)
        assert sum(o != "C" for *_, o in p) == cost(a, b)
        assert [i for i, _, _ in p if i is not None] == list(range(len(a)))
        assert [j for _, j, _ in p if j is not None] == list(range(len(b)))


def test_edit_align_and_wer(spark):
    d = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"]), ([], ["a"]), (None, None)], "r array<string>, h array<string>")
    got = d.select(L.edit_align(F.col("r"), F.col("h")).alias("x"), "r").select(F.transform("x", lambda x: x["op"]).alias("ops"), L.word_error_rate(F.col("x"), F.coalesce("r", F.array())).alias("wer")).collect()
    assert [r.ops for r in got] == [["C", "S", "C", "I"], ["I"], []]
    assert got[0].wer == pytest.approx(2 / 3) and got[1].wer == 1.0


def test_segment_starts(spark):
    d = spark.createDataFrame([([["a", "b"], ["c"], ["d", "e"]],), ([],)], "s array<array<string>>")
    assert [r[0] for r in d.select(L.segment_starts(F.col("s"))).collect()] == [[2, 3], []]


def test_boundaries(spark):
    d = spark.createDataFrame([("f", ["a", "b", "c", "d"], [["a", "b"], ["c", "d"]], [["a"], ["b", "x"], ["c", "d"]])], "k string, c array<string>, g array<array<string>>, a array<array<string>>")
    got = L.boundary_pairs(d, ["k"], "c", "g", "a").collect()
    assert [(r.op, r.gold, r.auto) for r in got] == [("C", False, False), ("C", False, True), ("I", False, False), ("C", True, True), ("C", False, False)]


def test_segments_to_time(spark):
    d = spark.createDataFrame([("f", [["a", "b"], ["zz"], ["c"]], [("a", 0.0, 1.0), ("b", 1.0, 2.0), ("c", 3.0, 4.0)])], "k string, g array<array<string>>, w array<struct<word:string,s:double,e:double>>")
    assert rows(L.segments_to_time(d, ["k"], "g", "w")) == [("f", 0, 0.0, 2.0), ("f", 2, 3.0, 4.0)]


def test_greedy_matches(spark):
    s = "k string, idx int, s double, e double, token string"
    g = spark.createDataFrame([("f", 0, 1.0, 1.2, "a"), ("f", 1, 1.5, 1.7, "a"), ("f", 2, 9.0, 9.1, "b"), ("f", 3, 0.0, 0.1, "")], s)
    p = spark.createDataFrame([("f", 0, 1.4, 1.6, "a"), ("f", 1, 3.4, 3.6, "a"), ("f", 2, 11.0, 11.1, "b")], s)
    assert [(r.g_idx, r.p_idx) for r in L.greedy_matches(g, p, ["k"]).orderBy("g_idx").collect()] == [(0, 0), (1, 1)]


def test_map_back():
    assert L.map_back(["a", "x", "b"], ["a", "q", "b"]) == [(0, 1), None, None]
    assert L.map_back(["a", "x", "b"], ["a", "q", "b"], 5) == [(0, 1), None, (2, 3)]
    assert L.map_back(["ab", "c"], ["a", "b", "c"], 5) == [(0, 2), (2, 3)]
    assert L.map_back(["a", "b"], []) == [None, None]


def test_aligner_times(spark):
    w = spark.createDataFrame([("f", 0, 0, "hi", "Hi", 0.0, 0.0), ("f", 0, 1, "uh", None, 0.0, 0.0), ("f", 1, 0, "", "--", 5.0, 5.5)], "k string, idx int, sub int, token string, word string, s double, e double")
    h = spark.createDataFrame([("f", 0, "hi", 0.1234, 0.5), ("f", 1, "uh", 0.6, 0.7)], "k string, idx int, token string, s double, e double")
    assert rows(L.aligner_times(w, h, ["k"])) == [("f", 0, "Hi", 0.123, 0.5, "mfa"), ("f", 1, "--", 5.0, 5.5, "rough")]


def test_repair_timeline(spark):
    d = spark.createDataFrame([([(0.5, 1.0, "a"), (0.8, 0.9, "b"), (2.0, 2.0, "c"), (3.0, 4.0, "")],)], "w array<struct<s:double,e:double,label:string>>")
    got = d.select(F.inline(L.repair_timeline(F.col("w"), F.lit(5.0)))).collect()
    assert [(round(r.s, 4), round(r.e, 4), r.label) for r in got] == [(0, 0.5, ""), (0.5, 1, "a"), (1, 1.001, "b"), (1.001, 2, ""), (2, 2.001, "c"), (2.001, 5, "")]


def test_retokenise(spark):
    d = spark.createDataFrame([("f", 0, "選びえあ", 0.0, 4.0), ("f", 1, "bad", 4.0, 5.0), ("f", 2, None, 5.0, 6.0)], "k string, idx int, word string, s double, e double")
    cut = {"選びえあ": ["選び", "え", "あ"], "bad": ["b", "d"]}
    assert rows(L.retokenise(d, ["k"], lambda w: cut[w])) == sorted([("f", 0, 0, "選び", 0.0, 2.0), ("f", 0, 1, "え", 2.0, 3.0), ("f", 0, 2, "あ", 3.0, 4.0), ("f", 1, 0, "bad", 4.0, 5.0)], key=repr)
