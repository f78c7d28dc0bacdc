"""Clause rules over dependency tokens: which tokens head a clause, of what kind, and clean-up of clause texts.

tokens: file_id, sent, i, text, lemma, pos, tag, dep, head_i. Children are found by one self-join on the head.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dependency labels, lemmas and words the rules name.
ELEMENTS_EN = ("obj", "iobj", "ccomp", "xcomp", "attr", "oprd", "dative", "dobj", "advmod", "npadvmod", "prep", "pobj", "agent")
ELEMENTS_JA = ("obj", "iobj", "obl", "advmod", "nmod")
COPULA_FORMS = ("'m", "'re", "'s", "is", "are", "was", "were")
STANCE_EN = ("think", "believe", "guess", "suppose", "know", "feel", "mean")
STANCE_JA = ("思う", "考える")
SUBORDINATORS_JA = ("から", "ながら", "つつ", "けど", "けれど", "が", "なら", "ば", "と", "し")
FILLERS_JA = ("えー", "え", "あー", "あ", "んー", "うーん", "えっと", "ええと", "まー", "まあ", "そのー", "その", "あのー", "あの", "ねー", "ね", "うん", "ふーん", "へー", "はい", "ええ")

KEYS = ["file_id", "sent"]


def verb_like(tag: Column, pos: Column) -> Column:
    return tag.contains("VB") | pos.isin("VERB", "AUX")


def filler_token(text: Column, tag: Column, dep: Column, pos: Column) -> Column:
    return text.isin(*FILLERS_JA) | F.coalesce(tag.contains("フィラー"), F.lit(False)) | ((dep == "discourse") & pos.isin("INTJ", "SYM"))


def with_children(tokens: DataFrame) -> DataFrame:
    """tokens with _kids, ARRAY<STRUCT<i, text, tag, dep, pos>> of their children; a sentence's tokens stay together."""
    kids = tokens.filter("head_i <> i").groupBy(*KEYS, F.col("head_i").alias("i")).agg(F.collect_list(F.struct(F.col("i").alias("i"), "text", "tag", "dep", "pos")).alias("_kids"))
    return tokens.join(kids, [*KEYS, "i"], "left").withColumn("_kids", F.coalesce("_kids", F.expr("cast(array() as array<struct<i:int,text:string,tag:string,dep:string,pos:string>>)")))


def clause_heads_en(tokens: DataFrame) -> DataFrame:
    """file_id, sent, i, clause_type of English clause heads."""
    t = with_children(tokens)
    verb = verb_like(F.col("tag"), F.col("pos"))
    copula = F.exists("_kids", lambda k: (k["dep"] == "cop") | ((k["dep"] == "nsubj") & F.lower(k["text"]).isin(*COPULA_FORMS)))
    element = F.exists("_kids", lambda k: k["dep"].isin(*ELEMENTS_EN) | k["dep"].startswith("obl"))
    ccomp = F.exists("_kids", lambda k: k["dep"] == "ccomp")
    dep, nonfinite = F.col("dep"), F.col("tag").isin("VBG", "VBN")
    kind = (
        F.when((dep == "ROOT") & F.lower("lemma").isin(*STANCE_EN) & ccomp, "minor").when((dep == "ROOT") & verb, "independent")
        .when((dep == "ROOT") & F.col("pos").isin("ADJ", "NOUN"), F.when(copula, "independent").otherwise("independent_copula_less"))
        .when((dep == "conj") & verb & element, "coordinated_vp").when(dep.isin("advcl", "acl") & (~nonfinite | element), F.concat(F.lit("subordinate_"), dep))
        .when(dep.isin("ccomp", "acl:relcl", "relcl", "csubj"), F.concat(F.lit("subordinate_"), dep)).when((dep == "xcomp") & element, "nonfinite_xcomp")
        .when(dep == "parataxis", "parataxis").when(~dep.isin("ROOT", "conj", "advcl", "acl", "xcomp") & nonfinite & element, "nonfinite_participle")
    )
    return t.select(*KEYS, "i", kind.alias("clause_type")).filter("clause_type is not null")


def clause_heads_ja(tokens: DataFrame) -> DataFrame:
    """file_id, sent, i, clause_type of Japanese clause heads. A subject alone is no element; a bare te-form is no clause."""
    no_ni = tokens.filter((F.col("dep") == "fixed") & F.col("text").isin("で", "に")).select(*KEYS, F.col("head_i").alias("i")).distinct().withColumn("_fixed", F.lit(True))
    marks = tokens.join(no_ni, [*KEYS, "i"], "left").filter((F.col("dep") == "mark") & (F.col("text").isin(*SUBORDINATORS_JA) | ((F.col("text") == "の") & F.col("_fixed"))))
    subordinated = marks.select(*KEYS, F.col("head_i").alias("i")).distinct().withColumn("_sub", F.lit(True))
    t = with_children(tokens).join(subordinated, [*KEYS, "i"], "left")
    not_filler = lambda k: ~filler_token(k["text"], k["tag"], k["dep"], k["pos"])
    element = F.exists("_kids", lambda k: k["dep"].isin(*ELEMENTS_JA) & not_filler(k))
    te = F.exists("_kids", lambda k: (k["dep"] == "mark") & k["text"].isin("て", "で"))
    ccomp = F.exists("_kids", lambda k: k["dep"] == "ccomp")
    copula = F.exists("_kids", lambda k: (k["pos"] == "AUX") & k["text"].isin("だ", "です"))
    filler = filler_token(F.col("text"), F.col("tag"), F.col("dep"), F.col("pos"))
    main = ~filler & F.col("pos").isin("VERB", "ADJ", "NOUN")
    inner = ~filler & (((F.col("pos") == "VERB") & ~F.coalesce(F.col("tag").contains("名詞"), F.lit(False))) | ((F.col("pos") == "ADJ") & (F.coalesce(F.col("tag").contains("形容詞"), F.lit(False)) | copula)))
    dep = F.col("dep")
    kind = (
        F.when((dep == "ROOT") & main & F.col("lemma").isin(*STANCE_JA) & ccomp, "MINOR").when((dep == "ROOT") & main, "IND")
        .when(inner & (dep == "acl"), "SUB_REL").when(inner & (dep == "ccomp"), "SUB_CCOMP").when(inner & (dep == "xcomp"), "SUB_XCOMP")
        .when(inner & (dep == "advcl"), F.when(F.col("_sub"), "SUB_ADVCL").when(element, F.when(te, "CHAIN_TE").otherwise("SUB_ADVCL")))
        .when(inner & (dep == "conj") & element, "COORD").when(inner & (dep == "parataxis"), "PARA")
    )
    return t.select(*KEYS, "i", kind.alias("clause_type")).filter("clause_type is not null")


def valid_clause_ja(text: Column, has_predicate: Column, kind: Column, has_element: Column) -> Column:
    """Whether a Japanese clause stays: stance clauses always; fragments, lone particles, set phrases of the session and
    short ones without predicate or (te-form) element go."""
    n = F.length(text)
    drop = (n < 3) | ((n == 3) & ~has_predicate) | text.rlike("^[をにがで]+$") | text.rlike("ＪＪＥ|お願いします") | (~has_predicate & (n < 10)) | ((kind == "CHAIN_TE") & ~has_element & (n < 12))
    return (kind == "MINOR") | ~drop


def cut_long(text: Column, most: int = 60) -> Column:
    """Texts over so many characters end at their last blank before that, or there."""
    head = F.substring(text, 1, most)
    return F.when(F.length(text) > most, F.regexp_replace(head, r"\s\S*$", "")).otherwise(text)


def recover_clauses(clauses: DataFrame) -> DataFrame:
    """English clean-up passes over clause rows (file_id, idx, clause_type, text, n_words, has_verb; unclaimed groups
    have the type 'fragment'): groups of at least three words with a verb, and fragments over five words, become
    parataxis; other fragments join the clause before (the one after at the start). file_id, idx, clause_type, text.

    A run of fragments joins as one; only neighbours of a file are looked at, through windows."""
    c = clauses.withColumn("clause_type", F.when((F.col("clause_type") == "fragment") & ((F.col("has_verb") & (F.col("n_words") >= 3)) | (F.col("n_words") > 5)), "parataxis").otherwise(F.col("clause_type")))
    w = Window.partitionBy("file_id").orderBy("idx")
    group = F.greatest(F.sum((F.col("clause_type") != "fragment").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    parts = F.sort_array(F.collect_list(F.struct("idx", "text")))
    kind = F.coalesce(F.min_by(F.when(F.col("clause_type") != "fragment", F.col("clause_type")), F.when(F.col("clause_type") != "fragment", F.col("idx"))), F.lit("fragment"))
    return c.withColumn("_g", group).groupBy("file_id", "_g").agg(F.min("idx").alias("idx"), kind.alias("clause_type"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text")).drop("_g")


def split_long_clause(words: Column, at: Column, most: int = 20, least: int = 3) -> Column:
    """ARRAY of word arrays: the clause cut at word `at` (start of a parataxis; null: none) if it has over `most` words
    and both halves at least `least`; else whole."""
    ok = (F.size(words) > most) & (at >= least) & (F.size(words) - at >= least)
    return F.when(F.coalesce(ok, F.lit(False)), F.array(F.slice(words, F.lit(1), at), F.slice(words, at + 1, F.size(words)))).otherwise(F.array(words))


def to_original_words(kept: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans over processed words as spans over the original ones: keys, idx, first, last.

    kept: keys, p (processed position), o (original position); spans: keys, idx, first, last (processed)."""
    a = kept.select(*keys, F.col("p").alias("first"), F.col("o").alias("_f"))
    b = kept.select(*keys, F.col("p").alias("last"), F.col("o").alias("_l"))
    return spans.join(a, [*keys, "first"]).join(b, [*keys, "last"]).select(*keys, "idx", F.col("_f").alias("first"), F.col("_l").alias("last"))


def tolerant_matches(gold: DataFrame, auto: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Per key: n_gold, n_auto, n_matched, boundaries (keys, at) matched one-to-one within a tolerance.

    A pair counts if the automatic boundary is the nearest to the gold one and no other gold one is nearer to it, so no
    boundary serves twice. Candidates meet in bins of the tolerance's width."""
    k = lambda c: F.floor(F.col(c) / F.lit(float(max(tolerance, 1e-9)))).cast("bigint")
    g = gold.select(*keys, F.col("at").alias("g")).distinct()
    a = auto.select(*keys, F.col("at").alias("a")).distinct()
    near = g.withColumn("_b", F.explode(F.array(k("g") - 1, k("g"), k("g") + 1))).join(a.withColumn("_b", k("a")), [*keys, "_b"]).filter(F.abs(F.col("g") - F.col("a")) <= tolerance)
    best = near.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "g").orderBy(F.abs(F.col("g") - F.col("a")), "a"))).filter("_n = 1")
    best = best.withColumn("_m", F.row_number().over(Window.partitionBy(*keys, "a").orderBy(F.abs(F.col("g") - F.col("a")), "g"))).filter("_m = 1")
    n = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return n(g, "n_gold").join(n(a, "n_auto"), keys, "full").join(n(best, "n_matched"), keys, "left").fillna(0)
