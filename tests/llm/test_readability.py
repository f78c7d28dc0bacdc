import random

import numpy as np
import pytest
from conftest import rows
from speechloom.llm import readability as R

EASY = ["the cat sat on the mat", "we ran to the old farm", "she has a red hat and a dog", "the boy hid the key"]
HARD = ["the methodological operationalisation of morphosyntactic reformulation necessitates considerable terminological differentiation", "probabilistic decomposition of interactional disfluency presupposes an incommensurability of configurations notwithstanding heterogeneity"]


def text(rng, kind, n=14):
    return " ".join(s[0].upper() + s[1:] + "." for s in (rng.choice(HARD if kind else EASY) for _ in range(n)))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    docs = [(i, text(rng, i % 2)) for i in range(120)]
    return spark.createDataFrame([*docs, (900, None), (901, ""), (902, "Short one.")], "doc_id bigint, text string"), spark.createDataFrame([(i, "r1", 2 + 3 * (i % 2) - (i % 4) // 2) for i in range(60)] + [(5, "r2", None), (None, "r2", 3), (9999, "r1", 4)], "doc_id bigint, rater string, reading_level int")


def test_profile():
    p = R.profile("A: It rained (cf. Fig. 6, approx. 0.72 s) today. We left! ")
    assert not p.ja and p.sentence == pytest.approx((9 + 2) / 2) and p.words[:2] == ["it", "rained"]
    assert R.profile("no stops at all " * 30).sentence is None and R.profile("").words == []
    j = R.profile("本研究では、\n分布を分析した。短い。")
    assert j.ja and j.sentence == pytest.approx((13 + 2) / 2) and j.words[0] == "本研" and j.size == 18


def test_held_out_accuracy(spark, tables):
    docs, levels = tables
    got = {r.doc_id: r.demanding for r in R.reading_levels(docs, levels).collect()}
    assert all(got[i] == bool(i % 2) for i in range(120)) and 900 not in got and 901 in got
    assert {r.doc_id for r in R.demanding(docs, levels).collect()} == {i for i in range(1, 120, 2)}


def test_without_ratings_and_empty(spark, tables):
    docs, levels = tables
    got = {r.doc_id: r.demanding for r in R.reading_levels(docs, levels.limit(0)).collect()}
    assert sum(got[i] == bool(i % 2) for i in range(120)) == 120
    assert R.demanding(docs.limit(0), levels).count() == 0


def test_copies_and_clashing_columns(spark, tables):
    docs, levels = tables
    d = docs.unionByName(docs.filter("doc_id < 3")).selectExpr("*", "1 as level", "'x' as ja", "2 as words")
    assert rows(R.demanding(d, levels.selectExpr("*", "5 as level"))) == [(i,) for i in sorted(range(1, 120, 2), key=lambda x: repr((x,)))]


def test_counts_do_not_depend_on_layout(spark, tables, monkeypatch):
    docs, _ = tables
    one = rows(R._frequencies(docs.coalesce(1), R.Model()).select("ja", "word", "in_hard", "in_easy"))
    assert one == rows(R._frequencies(docs.repartition(5), R.Model()).select("ja", "word", "in_hard", "in_easy"))


def test_fit_leans_on_the_prior():
    assert R.fit(np.empty((0, 1)), np.empty(0), (1.0, 2.0), (1.0, 1.0)) == pytest.approx((1.0, 2.0))
    x = np.linspace(0, 1, 5000)[:, None]
    assert R.fit(x, 3 + 0.5 * x[:, 0], (1.0, 2.0), (1.0, 1.0)) == pytest.approx((3.0, 0.5), abs=0.1)
