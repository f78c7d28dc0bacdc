import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from speechloom.operators import agreement as A

P = "g string, a double, b double"


def test_icc(spark):
    d = spark.createDataFrame([("c", 1.0, 1.0)] * 3 + [("x", float(i), float(i) + 0.1 * (i % 2)) for i in range(9)] + [("one", 1.0, 2.0)], P)
    got = {r.g: r.icc_2_1 for r in A.icc_2_1(d, ["g"]).collect()}
    assert got["c"] == 1.0 and got["x"] > 0.99 and got["one"] is None


def test_icc_far_from_zero(spark):
    rng = random.Random(2)
    v = [(rng.random(), rng.random() / 10) for _ in range(50)]
    near, far = (A.icc_2_1(spark.createDataFrame([("g", x + c, x + e + c) for x, e in v], P), ["g"]).first().icc_2_1 for c in (0.0, 1e7))
    assert near == pytest.approx(far, abs=1e-6)


def test_pearson_spearman(spark):
    d = spark.createDataFrame([("m", float(i), float(i**3)) for i in range(10)] + [("c", 1.0, float(i)) for i in range(4)] + [("t", x, x) for x in (1.0, 1.0, 2.0)] + [("m", None, 1.0)], P)
    r = {x.g: x for x in A.pearson(d, ["g"]).collect()}
    s = {x.g: x.spearman_rho for x in A.spearman(d, ["g"]).collect()}
    assert r["c"].pearson_r is None and r["m"].n == 10 and r["m"].mae == pytest.approx(198.0)
    assert s["m"] == pytest.approx(1.0) and s["t"] == pytest.approx(1.0)


def test_distributed_ranks_are_average_ranks(spark):
    rng = random.Random(3)
    d = spark.createDataFrame([("g", float(rng.randrange(30)), 0.0) for _ in range(300)], P)
    want = {r.a: r.r for r in d.select("a", A.average_rank("a", ["g"]).alias("r")).collect()}
    counts = d.groupBy("g", F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    assert {r.v: r.rank for r in A.average_ranks(counts, ["g"]).collect()} == want


def test_percentiles_are_exact(spark):
    import numpy as np

    rng = random.Random(5)
    values = {g: [rng.choice([rng.random(), float(rng.randrange(4))]) for _ in range(n)] for g, n in (("a", 1), ("b", 2), ("c", 500), (None, 7))}
    d = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("a", float("nan"))], "g string, v double")
    got = {r.g: r[1:] for r in A.percentiles(d, ["g"], (0.0, 0.25, 0.9)).collect()}
    assert set(got) == set(values) and all(got[g] == pytest.approx(list(np.percentile(vs, [0, 25, 90]))) for g, vs in values.items())


def test_p_values(spark):
    assert A._tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert A._tail(0.0, 5) == 1.0 and A._tail(math.inf, 5) == 0.0
    d = spark.createDataFrame([(0.5, 12), (1.0, 5), (None, 5), (0.3, 2)], "r double, n bigint")
    got = [x[0] for x in d.select(A.p_value("r", "n")).collect()]
    assert got[0] == pytest.approx(0.0979, abs=1e-3) and got[1] == 0.0 and got[2] is None and got[3] is None


def test_scores_of_nothing(spark):
    d = spark.createDataFrame([(False, False)] * 4, "auto boolean, gold boolean")
    r = A.scores(A.confusion(d, [])).first()
    assert (r.tn, r.precision, r.recall, r.f1, r.kappa) == (4, 1.0, 1.0, 1.0, 1.0)


def test_kappa_is_symmetric(spark):
    rng = random.Random(6)
    d = spark.createDataFrame([(rng.random() < 0.4, rng.random() < 0.5) for _ in range(60)], "auto boolean, gold boolean")
    k = [A.scores(A.confusion(x, [])).first().kappa for x in (d, d.select(F.col("gold").alias("auto"), F.col("auto").alias("gold")))]
    assert k[0] == pytest.approx(k[1])


def test_location_scores(spark):
    d = spark.createDataFrame([("a", "mid", "mid"), ("a", "end", "end"), ("b", "end", "end")], "t string, auto string, gold string")
    got = {r.t: r for r in A.location_scores(d, ["t"]).collect()}
    assert got["a"].kappa == 1.0 and got["a"].mcp_f1 == 1.0 and got["b"].accuracy == 0.0


def test_auc(spark):
    d = spark.createDataFrame([("a", 0.1, 0), ("a", 0.4, 1), ("a", 0.4, 0), ("a", 0.9, 1), ("b", 1.0, 1)], "g string, v double, y int")
    got = {r.g: r.auc for r in A.roc_auc(d, ["g"], "v", F.col("y") == 1).collect()}
    assert got == {"a": 0.875, "b": None}


def test_macro_leaves_nan_out(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", float("nan"))], "g string, x double")
    assert rows(A.macro(d, ["g"], ["x"])) == [("a", 2, 1.0), ("b", 1, None)]


def test_rounding(spark):
    d = spark.createDataFrame([(2.675, 2), (0.0625, 3), (None, 1)], "v double, k int")
    assert [r[0] for r in d.select(A.round_half_even("v", "k")).collect()] == [2.67, 0.062, None]


def test_describe(spark):
    r = A.describe(spark.createDataFrame([("g", float(i)) for i in range(1, 6)] + [("g", None)], "g string, x double"), ["g"], ["x"]).first()
    assert (r["count"], r["mean"], r["min"], r["p25"], r["p50"], r["max"]) == (5, 3.0, 1.0, 2.0, 3.0, 5.0)


def test_correlations_are_the_single_statistics(spark):
    rng = random.Random(11)
    v = [(f"f{i}-ST{i % 2 + 1}", x := rng.random(), x + rng.random() / 5) for i in range(30)]
    d = spark.createDataFrame(v, "file string, AR_auto double, AR_manual double")
    got = {r.subset: r for r in A.correlations(d, ("AR",), F.substring("file", -3, 3), "t").collect()}
    assert {k: r.n for k, r in got.items()} == {"Overall": 30, "ST1": 15, "ST2": 15}
    p = d.selectExpr("'g' as g", "AR_auto as a", "AR_manual as b")
    r = got["Overall"]
    assert r.pearson_r == pytest.approx(A.pearson(p, ["g"]).first().pearson_r) and r.icc_2_1 == pytest.approx(A.icc_2_1(p, ["g"]).first().icc_2_1)
    assert r.spearman_rho == pytest.approx(A.spearman(p, ["g"]).first().spearman_rho) and 0 < r.pearson_p < 0.01
