import pytest
from conftest import rows
from speechloom.llm import lookalikes as K

FORMS = ["the", "you", "don't", "café", "fire", "コーヒー", "タクシー", "へ", "ヘリコプター", "一番", "うーん", "сон", "дом", "говор", "図書館", "が"]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(list(enumerate(FORMS, 1)), "lex_id int, form string")


@pytest.mark.parametrize("odd,form", [
    ("tһе", "the"), ("ｔｈｅ", "the"), ("t​he", "the"), ("the\xa0", "the"), ("уοu", "you"), ("don’t", "don't"), ("donʼt", "don't"), ("café", "café"), ("ﬁre", "fire"), ("ｺｰﾋｰ", "コーヒー"), ("コ―ヒ一", "コーヒー"),
    ("夕クシー", "タクシー"), ("ヘ", "へ"), ("へリコプター", "ヘリコプター"), ("ー番", "一番"), ("う一ん", "うーん"), ("coн", "сон"), ("дoм", "дом"), ("図書館 ", "図書館"), ("か‍゙", "が"), (" the ", "the"), ("t︀h͏e", "the"),
])
def test_found(spark, lexicon, odd, form):
    d = spark.createDataFrame([(odd,)], "w string")
    got = [(r.lex_id, r.form) for r in K.is_lexicon_alike(d, "w", lexicon).collect()]
    assert got == [(FORMS.index(form) + 1, form)]


@pytest.mark.parametrize("odd,form", [("\u0261ood", "good"), ("\u0251nd", "and"), ("w\u0131th", "with"), ("\u0185ut", "but"), (" \u0261ood\u2009", "good")])
def test_latin_letters_that_look_alike(spark, odd, form):
    forms = ["good", "and", "with", "but", "café"]
    lexicon, d = spark.createDataFrame(list(enumerate(forms)), "lex_id int, form string"), spark.createDataFrame([(odd,), ("cafe",), ("cafè",)], "w string")
    assert [r.form for r in K.is_lexicon_alike(d, "w", lexicon).collect()] == [form]
    assert K.unify(d, "w", lexicon).first().w.strip() == form and K.Lexicon(forms).differs(odd)


def test_not_found(spark, lexicon):
    plain = [*FORMS, "", " ", None, "we-", "[noise]", "The", "th", "mhkt", "ビール", "кот"]
    assert K.is_lexicon_alike(spark.createDataFrame([(w,) for w in plain], "w string"), "w", lexicon).count() == 0


def test_empty_and_clashing_columns(spark, lexicon):
    d = spark.createDataFrame([("tһe", 9, 8, 7)], "w string, form int, lex_id int, x int")
    assert rows(K.is_lexicon_alike(d, "w", lexicon)) == [("tһe", 7, 1, "the")]
    assert K.is_lexicon_alike(d.limit(0), "w", lexicon).count() == 0 and K.is_lexicon_alike(d, "w", lexicon.limit(0)).count() == 0


@pytest.mark.parametrize("text,odd", [
    ("the fire you", False), ("the fire", True), ("the fіre", True), ("we- [noise] <unk> café", False), ("café", True), ("図書館へコーヒー", False), ("図書館ヘコーヒー", True), ("ヘリコプターがうーん", False),
    ("ヘリコプターがう一ん", True), ("一番タクシー", False), ("一番夕クシー", True), ("図書館 が", False), ("図書館　が", True), ("кот", False), ("", False), ("the\tfire", True), ("the mhkt", False), ("the мама", False),
])
def test_differs(text, odd):
    assert K.Lexicon(FORMS).differs(text) is odd


def test_scripts():
    own, able = K.resolved_scripts("tһе")
    assert own == {"LATIN", "CYRILLIC"} and "LATIN" in able
    assert [K.unify_script(w) for w in ("тhе", "кid", "сaп", "каt", "нello", "Ꭺpple", "ꓮpple")] == ["the", "kid", "can", "kat", "hello", "Apple", "Apple"]
    own, able = K.resolved_scripts("сор")
    assert own == {"CYRILLIC"} and able >= {"CYRILLIC", "LATIN"}
    assert K.unify_script("wһісh") == "which" and K.unify_script("дoм") == "дом" and K.unify_script("ａｂ​") == "ab" and K.unify_script("сор") == "сор" and K.unify_script("сор", {"cop": "cop"}) == "cop"


def test_unify(spark, lexicon):
    d = spark.createDataFrame([("plain", 1), ("ｆｉｒe\xa0уou", 2), (None, 3), ("", 4)], "t string, n int")
    assert {r.n: r.t for r in K.unify(d, "t", lexicon).collect()} == {1: "plain", 2: "fire you", 3: None, 4: ""}


@pytest.mark.parametrize("text,plain", [
    ("図書館ヘコ―ヒ一", "図書館へコーヒー"), ("ヘリコプターがう\u2015ん", "ヘリコプターがうーん"), ("ー番夕クシー", "一番タクシー"), ("図書館\u3000が", "図書館が"), ("図書館 が", "図書館 が"), ("夕クシー が ー番", "タクシー が 一番"),
    ("うーん図書館へ", "うーん図書館へ"), ("дoмがtһе", "домがthe"), ("tһе fire\u2009 уοu\xa0", "the fire you"), ("the\tfire", "the fire"), ("か\u3099コ\u2014ヒー", "がコーヒー"), ("\u0435\u0302がう一ん", "\u0435\u0302がうーん"), ("кот the", "кот the"), ("", ""), (None, None),
])
def test_plain_transcripts(spark, lexicon, text, plain):
    d = spark.createDataFrame([(text,)], "t string")
    got = K.unify(d, "t", lexicon).first().t
    assert got == plain and (got is None or not K.Lexicon(FORMS).differs(got))


def test_plain_transcripts_of_tables(spark, data):
    from speechloom.llm.lookalikes_queries import QUERIES

    before = spark.read.parquet(f"{data}/asr_json.parquet").select("file_id", "chunk_no", "transcript")
    after = QUERIES["p4_plain_transcripts"](spark, data)
    changed = before.subtract(after).select("file_id", "chunk_no").distinct()
    assert after.count() == before.count() and rows(changed) == rows(QUERIES["p4_found"](spark, data).filter("field = 'transcript'").select("file_id", "chunk_no").distinct())


def test_long_text():
    long = "図書館へ" * 5_000
    assert not K.Lexicon(FORMS).differs(long) and K.Lexicon(FORMS).differs(long + "夕クシー")


def test_large_lexicon_is_refused(spark, lexicon, monkeypatch):
    monkeypatch.setattr(K, "MAX_LEXICON", 3)
    with pytest.raises(ValueError):
        K.is_lexicon_alike(spark.createDataFrame([("x",)], "w string"), "w", lexicon)


def test_unicode_table(spark, monkeypatch):
    here = len(K.unicode_prototypes())
    assert here > 6000
    # Workers have the package as a zip file elsewhere.
    there = spark.sparkContext.parallelize([0], 1).map(lambda _: (len(K.unicode_prototypes()), len(K._FOUND))).first()
    assert there == (here, len(K._FOUND))
    monkeypatch.setattr(K, "_icu_jars", lambda: [])
    with pytest.raises(RuntimeError, match="icu4j"):
        K.unicode_prototypes()
