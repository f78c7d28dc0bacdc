import random

from conftest import rows
from pyspark.sql import functions as F
from speechloom.operators import clauses as CL
from speechloom.operators import corpus as C
from speechloom.operators import injectors as J


def test_markup():
    assert C.parse_markup("[ I, + I ] guess {F uh, } we-") == (["i", "i", "guess", "uh", "we-"], [1, 0, 0, 1, 1])
    assert C.parse_markup("{C and } [ [ a, + b, ] + c ] <laughter> -- d. /") == (["and", "a", "b", "c", "d"], [0, 1, 0, 0, 0])
    assert C.parse_markup("{D you know, } {x} #") == (["you", "know", "x"], [1, 1, 0])
    assert C.parse_markup("<<noise>> /") is None and C.parse_markup(None) is None and C.parse_markup("") is None


def test_derived_labels(spark):
    d = spark.createDataFrame([("i um i went", "i went"), ("a b", "b a"), ("uh", "None"), ("a", "a")], "d string, f string").select(F.split("d", " ").alias("d"), F.split("f", " ").alias("f"))
    assert [r[0] for r in d.select(C.derive_labels(F.col("d"), F.col("f"))).collect()] == [[1, 1, 0, 0], None, [1], [0]]


def test_majority(spark):
    d = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 1)], "s int, w int, y int")
    assert rows(C.majority_labels(d, ["s"], "w", "y")) == [(1, 0, 0), (1, 1, 1)]


def test_act_tags(spark):
    d = spark.createDataFrame([(x,) for x in ("qy^d", "nn^e", "sd(^q)", "b^r", "fx", "oo", "sd*,qy", "aap", '"', "sv")], "t string")
    assert [r[0] for r in d.select(C.act_tag(F.col("t"))).collect()] == ["qy^d", "ng", "sd", "b", "sv", "oo_co_cc", "sd", "aap_am", 'fo_o_fw_"_by_bc', "sv"]


def test_pos_and_trees(spark):
    d = spark.createDataFrame([("my/PRP$ wife/NN went/VBD ./.", ["(S (PRP$ my) (NN wife) (VBD went) (. .))"]), ("a/DT b/c/d", ["(S (DT x))"]), ("a/DT", None)], "p string, t array<string>")
    assert [r[0] for r in d.select(C.tree_matches(F.col("p"), F.col("t"))).collect()] == [True, False, False]
    assert [tuple(x) for x in d.select(C.tagged_words(F.col("p"), True)).first()[0]][:3] == [("my", "prp$"), ("wife", "n"), ("went", "v")]


def test_splits(spark):
    d = spark.createDataFrame([(x,) for x in (4000, 4199, 4200, 4500, 5000)], "c int")
    assert [r[0] for r in d.select(C.split_of_conversation(F.col("c"))).collect()] == ["test", "test", "train", "valid", "train"]
    lines = spark.range(7).select(F.col("id").alias("n"))
    assert C.first_third_to_test(lines, "n").filter("split = 'test'").count() == 2
    assert [r[0] for r in spark.createDataFrame([("Training",), ("dev",), ("x",)], "s string").select(C.plain_split(F.col("s"))).collect()] == ["train", "valid", None]


def test_sample_is_the_same_on_any_layout(spark):
    d = spark.range(200).select("id", (F.col("id") % 3).alias("g"))
    one, two = (rows(C.sample_per_group(x, ["g"], "id", 5, 1)) for x in (d, d.repartition(7)))
    assert one == two and len(one) == 15


def test_utterances_join_in_order(spark):
    d = spark.createDataFrame([(1, 2, "A", 1, "b"), (1, 1, "A", 1, "a"), (1, 1, "A", 1, "a"), (1, 3, "A", None, "x"), (1, 4, "A", 1, None)], "conversation_no int, transcript_index int, caller string, utterance_index int, text string")
    assert [r.text for r in C.utterance_texts(d).collect()] == ["a b "]


def test_injected_sentences_hold_the_clean_words():
    words, n = "the boy went to the big house with a dog".split(), 0
    for seed in range(200):
        out = J.inject(words, random.Random(seed), J.ENGLISH)
        if out:
            n += 1
            it = iter(" ".join(out).split())
            assert all(w in it for w in words) and len(out) > len(words)
    assert n > 150
    assert J.inject(["a"], random.Random(1), J.ENGLISH) is None
    assert J.inject("私 は 本 を 読み ました".split(), random.Random(3), J.JAPANESE, lambda w: "よみ") is not None
    assert not any(J.kana_reading(w) for w in ("本", "読み", "")) and J.kana_reading("カメラ") == "カメラ"


def test_injection_does_not_depend_on_layout(spark):
    d = spark.range(60).select(F.array(*map(F.lit, "we saw the big red house today".split())).alias("w"), "id")
    f = lambda x: rows(x.select("id", J.injected(F.col("w"), F.col("id"), 7, J.ENGLISH)))
    assert f(d) == f(d.repartition(5))


TOKENS = "file_id string, sent int, i int, text string, lemma string, pos string, tag string, dep string, head_i int"


def test_english_clauses(spark):
    t = [("f", 0, 0, "I", "I", "PRON", "PRP", "nsubj", 1), ("f", 0, 1, "think", "think", "VERB", "VBP", "ROOT", 1), ("f", 0, 2, "she", "she", "PRON", "PRP", "nsubj", 3), ("f", 0, 3, "is", "be", "AUX", "VBZ", "ccomp", 1), ("f", 0, 4, "happy", "happy", "ADJ", "JJ", "acomp", 3),
         ("f", 1, 0, "took", "take", "VERB", "VBD", "ROOT", 0), ("f", 1, 1, "car", "car", "NOUN", "NN", "obj", 0), ("f", 1, 2, "danced", "dance", "VERB", "VBD", "conj", 0), ("f", 1, 3, "went", "go", "VERB", "VBD", "conj", 0), ("f", 1, 4, "home", "home", "ADV", "RB", "advmod", 3)]
    assert rows(CL.clause_heads_en(spark.createDataFrame(t, TOKENS))) == sorted([("f", 0, 1, "minor"), ("f", 0, 3, "subordinate_ccomp"), ("f", 1, 0, "independent"), ("f", 1, 3, "coordinated_vp")], key=repr)


def test_japanese_clauses(spark):
    t = [("f", 0, 0, "起き", "起きる", "VERB", "動詞", "advcl", 4), ("f", 0, 1, "て", "て", "SCONJ", "助詞", "mark", 0), ("f", 0, 2, "本", "本", "NOUN", "名詞", "obj", 3), ("f", 0, 3, "読ん", "読む", "VERB", "動詞", "advcl", 4), ("f", 0, 4, "寝た", "寝る", "VERB", "動詞", "ROOT", 4), ("f", 0, 5, "で", "で", "SCONJ", "助詞", "mark", 3),
         ("f", 0, 6, "雨だ", "雨", "VERB", "動詞", "advcl", 4), ("f", 0, 7, "から", "から", "SCONJ", "助詞", "mark", 6), ("f", 0, 8, "えー", "えー", "INTJ", "感動詞", "discourse", 4)]
    assert rows(CL.clause_heads_ja(spark.createDataFrame(t, TOKENS))) == sorted([("f", 0, 3, "CHAIN_TE"), ("f", 0, 4, "IND"), ("f", 0, 6, "SUB_ADVCL")], key=repr)


def test_clause_clean_up(spark):
    c = spark.createDataFrame([("f", 0, "fragment", "um", 1, False), ("f", 1, "independent", "he ran", 2, True), ("f", 2, "fragment", "the bird pop out", 4, True), ("f", 3, "fragment", "and bird", 2, False)], "file_id string, idx int, clause_type string, text string, n_words int, has_verb boolean")
    assert rows(CL.recover_clauses(c)) == [("f", 0, "independent", "um he ran"), ("f", 2, "parataxis", "the bird pop out and bird")]
    w = spark.createDataFrame([([str(i) for i in range(22)], 14), (["a"] * 22, 1), (["a"] * 5, None)], "w array<string>, at int")
    assert [[len(p) for p in r[0]] for r in w.select(CL.split_long_clause(F.col("w"), F.col("at"))).collect()] == [[14, 8], [22], [5]]
    assert spark.range(1).select(CL.cut_long(F.lit("abc def ghi"), 8)).first()[0] == "abc def"


def test_tolerant_matches(spark):
    g = spark.createDataFrame([("f", 1.0), ("f", 2.0), ("f", 9.0)], "k string, at double")
    a = spark.createDataFrame([("f", 1.1), ("f", 2.3), ("f", 2.05)], "k string, at double")
    assert rows(CL.tolerant_matches(g, a, ["k"], 0.15)) == [("f", 3, 3, 2)]


def test_original_words(spark):
    k = spark.createDataFrame([("f", 0, 0), ("f", 1, 3), ("f", 2, 4)], "k string, p int, o int")
    s = spark.createDataFrame([("f", 0, 0, 1), ("f", 1, 2, 2)], "k string, idx int, first int, last int")
    assert rows(CL.to_original_words(k, s, ["k"])) == [("f", 0, 0, 3), ("f", 1, 4, 4)]


def test_files_kept(spark):
    d, ids = spark.createDataFrame([("a",), ("b",)], "file_id string"), spark.createDataFrame([("a",), ("a",)], "file_id string")
    assert rows(C.keep_files(d, ids, True)) == [("a",)] and C.keep_files(d, None, False).count() == 2
    assert C.keep_files(d, ids.limit(0), True).count() == 2 and C.keep_files(d, ids.limit(0), False).count() == 0
    assert rows(C.presence(d, {"x": ids, "y": d.limit(0)})) == [("a", "no y"), ("b", "no x")]


def test_small_functions(spark):
    r = spark.createDataFrame([([1, 0], [None, 0, 0, 1, None], "sw_0001_4325.utt")], "y array<int>, w array<int>, f string").select(C.subtoken_labels(F.col("y"), F.col("w")), C.conversation_of_file(F.col("f")), C.conversation_of_file(F.lit("x"))).first()
    assert tuple(r) == ([-100, 1, 1, 0, -100], 4325, None)


def test_source_words_before_line_breaks(spark):
    w = spark.createDataFrame([(["The", "dog\n", "\nran", "o n", "café", "x1"],)], "w array<string>").select(C.source_sentence_en(F.col("w"))).first()[0]
    assert w == ["the", "café"]
