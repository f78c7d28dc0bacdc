import pytest
from pyspark.sql import functions as F
from speechloom.functions import text as T


def col(spark, values, fn):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(fn(F.col("c"))).collect()]


def test_units(spark):
    assert col(spark, ["the", "bubble", "<unk>", "queue", "make", "hmm"], T.syllables) == [1] * 6
    assert col(spark, ["きゃ", "がっこう", "コーヒー", "ー"], T.moras) == [1, 3, 2, 1]


def test_pauses(spark):
    assert col(spark, ["sp", " SIL ", "", None, "silB", "um", "　"], T.is_pause) == [True, True, True, True, False, False, True]
    assert col(spark, ["silB"], lambda c: T.is_pause(c, T.PAUSE_EXTENDED)) == [True]
    assert col(spark, ["silB"], lambda c: T.is_pause(c, T.PAUSE_JA_BASELINE)) == [False]


def test_normalisers(spark):
    assert col(spark, ["  A　b\tC "], T.normalize) == ["a b c"]
    assert col(spark, ["\"Don''t!\""], T.aligner_token_en) == ["don't"]
    assert col(spark, ["「あの、」"], T.aligner_token_ja) == ["あの"]
    assert col(spark, ["(Well-known)"], T.clean_word_en) == ["wellknown"]
    assert col(spark, ["えっと〜 、"], T.surface) == ["えっとー"]


@pytest.mark.parametrize("gap,n", [(0.39, 0), (0.4, 1), (0.91, 2), (1.46, 3), (5.0, 3)])
def test_filler_count(spark, gap, n):
    assert spark.range(1).select(T.gap_filler_count(F.lit(gap))).first()[0] == n


def test_choose_filler(spark):
    pools = (("a", "b", "c"), ("d", "e"), ("f",))
    sign = "あ|い|50|1"
    got = spark.range(1).select(T.choose_filler(F.lit(0.5), F.lit("あ"), F.lit("い"), F.lit(1), pools), T.choose_filler(F.lit(9.0), F.lit("x"), F.lit("y"), F.lit(0), pools)).first()
    assert tuple(got) == (pools[0][sum(map(ord, sign)) % 3], "f")


def test_tasks_and_names(spark):
    assert col(spark, ["X-ST1", "X-ST2", "X"], T.task_en) == ["ST1", "ST2", "ST2"]
    assert col(spark, ["X-ST1", "X-ST2", "X"], T.task_ja) == ["ST1", "ST2", "OTHER"]
    assert col(spark, ["/a/b/SPK_01-ST1_vad_classifier.csv", "C:\\x\\Y.TextGrid"], T.file_stem) == ["SPK_01-ST1", "Y"]


def test_kana(spark):
    assert col(spark, ["カタカナ", "漢字ヴ"], T.to_hiragana) == ["かたかな", "漢字ゔ"]
    assert col(spark, ["ケイサツツ", "バス"], lambda c: T.mispronounce(c, (("ツ", "チュ"), ("ン", "ヌ")))) == ["ケイサチュツ", None]


def test_ratios(spark):
    r = spark.range(1).select(T.ratio(F.lit(1), F.lit(0), 1.0), T.safe_div(F.lit(1.0), F.lit(0.0)), T.metric_label(F.lit(None).cast("double"))).first()
    assert r[0] == 1.0 and r[1] != r[1] and r[2] == "NA"
