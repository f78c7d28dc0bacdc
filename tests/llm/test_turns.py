import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from speechloom.llm import turns as U

ROW = "conversation_no int, transcript_index int, caller string, utterance_index int, subutterance_index int, text string"
META = "conversation_no int, from_caller int, to_caller int"


def col(spark, values, fn):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(fn(F.col("c"))).collect()]


def test_clean_text(spark):
    texts = ["A >> {C so } [ our neighbor, + our neighbor ] stayed to the lake. /", "00:00:27.764 {D you know, } the kids went <laughter> -/", "(00:23) ((breath)) Uh -- /", "2:31 -->/", "um... we called at 11:30, /", "[laughs] [BEEP] ♪ # *clears throat* <<background noise>>", None, "", "Speaker B: ummm,  the [ kid co-, + kid ] /"]
    assert col(spark, texts, U.clean_text) == ["so our neighbor, our neighbor stayed to the lake.", "you know, the kids went", "", "", "we called at 11:30,", "", "", "", "the kid co-, kid"]


@pytest.mark.parametrize("text,word", [("Oh, yes. /", True), ("hmmmm, /", False), ("Errm... -/", False), ("mm", False), ("ha- /", True), ("um- brella", True), ("5", True), ("[t=29.8s]", False), ("summer", True), ("her", True)])
def test_has_word(spark, text, word):
    assert col(spark, [text], U.has_word) == [word]


def test_labels(spark):
    labels = ["A", " b ", "@B", "[A]", "Speaker A", "speakerB", "SPK_A", "Caller-B", "Ａ", "A:", "B.", "caller a", "Speeker-A", "1399", "?", "", None, "AB", "Bob"]
    assert col(spark, labels, U.label_side) == ["A", "B", "B", "A", "A", "B", "A", "B", "A", "A", "B", "A", "A", None, None, None, None, None, None]


def speakers(spark, data, meta=()):
    d = U.resolve_speakers(spark.createDataFrame(data, ROW), spark.createDataFrame(list(meta), META))
    return {(r.conversation_no, r.transcript_index): r.speaker for r in d.collect()}


def test_evidence(spark):
    data = [(1, 1, "A", 1, 1, "hi"), (1, 2, None, 1, 2, "so"), (1, 3, "77", 2, 1, "x"), (1, 4, "?", 3, 1, "B> no"), (1, 5, None, 4, 1, None), (1, 6, None, None, None, "lost"), (1, 1, "caller a", 1, 1, "hi")]
    got = speakers(spark, data, [(1, 50, 77), (1, 50, 77), (1, None, None)])
    assert got == {(1, 1): "A", (1, 2): "A", (1, 3): "B", (1, 4): "B", (1, 5): None, (1, 6): None}


def test_unknown_labels_are_assigned_one_to_one(spark):
    data = [(1, 1, "x9", 1, 1, "a"), (1, 2, "A", 1, 2, "a"), (1, 3, "y9", 2, 1, "a"), (1, 4, "x9", 3, 1, "a"), (2, 1, "q9", 1, 1, "a"), (2, 2, "B", 1, 2, "a")]
    assert speakers(spark, data) == {(1, 1): "A", (1, 2): "A", (1, 3): "B", (1, 4): "A", (2, 1): "B", (2, 2): "B"}


@pytest.mark.parametrize("block", [3, 10, 50_000])
def test_turns_against_brute_force(spark, block):
    rng = random.Random(block)
    data = [(c, i, rng.choice(["A", "A", "B", None])) for c in range(8) for i in sorted(rng.sample(range(60), rng.randrange(1, 40)))]
    want = []
    for c in range(8):
        runs = []
        for _, i, s in (d for d in data if d[0] == c and d[2]):
            if runs and runs[-1][0] == s:
                runs[-1][2] = i
            else:
                runs.append([s, i, i])
        want += [(c, n, *r) for n, r in enumerate(runs, 1)]
    got = U.speaker_turns(spark.createDataFrame(data, "conversation_no int, transcript_index int, speaker string"), block)
    assert rows(got) == sorted(want, key=repr)


def test_empty_and_further_columns(spark):
    d = spark.createDataFrame([(1, 1, "A", 1, 1, "hi there"), (1, 2, "B", 2, 1, "uh /")], ROW).selectExpr("*", "'z' as speaker", "3 as number", "4 as label")
    m = spark.createDataFrame([(1, 5, 6)], META).selectExpr("*", "1 as side")
    assert rows(U.clean_turns(d, m)) == [(1, 1, "A", 1, 1)]
    assert rows(U.clean_turns(d.limit(0), m.limit(0))) == [] and U.clean_turns(d, m.limit(0)).count() == 1


def test_long_text(spark):
    long = "um, " * 20_000 + "word"
    assert col(spark, [long], U.clean_text) == ["word"]


def test_open_labels_take_the_free_side(spark):
    said = {1: ["A", "x"], 2: ["B", "x", "x"], 3: ["x"], 4: ["x", "y", "z"], 5: ["A", "x", "y", "z"], 6: ["A", "B", "x"]}
    d = spark.createDataFrame([(c, i, who, i, 1, "hi") for c, w in said.items() for i, who in enumerate(w, 1)], ROW)
    got = {}
    for r in U.resolve_speakers(d, spark.createDataFrame([], META)).orderBy("conversation_no", "transcript_index").collect():
        got.setdefault(r.conversation_no, []).append(r.speaker)
    assert got == {1: ["A", "B"], 2: ["B", "A", "A"], 3: ["A"], 4: ["A", "B", "B"], 5: ["A", "B", "B", "B"], 6: ["A", "B", None]}


def test_clean_words_of_recogniser_output(spark, tmp_path):
    words = [("so", 0.0, 0.5), ("uh", 0.5, 0.7), ("<noise>", 0.7, 0.9), (" well, ", 0.9, 1.4), (None, 1.4, 1.5), ("", 1.5, 1.6), ("fine", None, 2.0)]
    other = [("um", 0.0, 0.1)]
    spark.createDataFrame([("f", 0, words), ("f", 0, words), ("f", 1, other)], "file_id string, chunk_no int, words array<struct<word string, start double, end double>>").write.parquet(f"{tmp_path}/asr_json.parquet")
    from speechloom.llm.turns_queries import QUERIES

    assert rows(QUERIES["p3_asr_clean_words"](spark, str(tmp_path))) == [("f", 0, 0, "so", 0.0, 0.5), ("f", 0, 3, "well,", 0.9, 1.4), ("f", 0, 6, "fine", None, 2.0)]
    assert rows(QUERIES["p3_asr_words"](spark, str(tmp_path))) == [("f", 0, 7, 3), ("f", 1, 1, 0)]


def test_shortcut_of_has_word_agrees_with_clean_text(spark, data):
    texts = spark.read.parquet(f"{data}/swda_utterance.parquet").select("text").unionByName(spark.read.parquet(f"{data}/asr_json.parquet").select(F.explode("words").alias("w")).select(F.col("w.word").alias("text"))).distinct()
    assert texts.count() > 500 and texts.filter(~U.has_word(F.col("text")).eqNullSafe(U.clean_text(F.col("text")).rlike(r"[\p{L}\p{N}]"))).count() == 0


def test_role_words_are_learned_across_transcripts(spark):
    d = spark.createDataFrame([(c, i, who, i, 1, "hi") for c in range(3) for i, who in enumerate(["Talker A", "talker-b", "Tolker B", "Mr B"], 1)], ROW)
    assert U.learned_roles(d) == (*U.ROLES, "talker")
    assert {r.transcript_index: r.speaker for r in U.resolve_speakers(d.filter("transcript_index < 4"), spark.createDataFrame([], META)).collect()} == {1: "A", 2: "B", 3: "B"}
