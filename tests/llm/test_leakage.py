import random

from conftest import rows
from speechloom.llm import leakage as G

ITEM = "Near the lake Pursalr started her little basket so later Pursalr told the driver about 7 thin houses and then they all went home"
JA = "ボガイウトは古い傘を探しました。ボガイウトにぼうしを渡し、ドノセミマが台所で待ち、店の人は小さい服を直しました。"


def frames(spark, docs, items=((1, ITEM), (2, JA), (3, "too short"), (4, None), (5, ""))):
    return spark.createDataFrame(list(docs), "doc_id bigint, text string"), spark.createDataFrame(list(items), "item_id bigint, text string")


def found(spark, *texts):
    return rows(G.leaks(*frames(spark, enumerate(texts))))


def test_as_it_reads(spark):
    w = ITEM.split()
    part = " ".join(w[3:15])
    texts = ["before " + part.upper() + " after", part.replace(" ", "\n| "), "x <b>" + part + "</b>", part.replace("e", "е", 2).replace(" ", "\xa0", 3), ", ".join(w[3:15]), "&quot;" + part, part.replace("told", "to<i>l</i>d"), part.replace("started", "st​arted")]
    assert found(spark, *texts) == [(i, 1) for i in range(len(texts))]


def test_too_little(spark):
    w = ITEM.split()
    assert found(spark, " ".join(w[3:14]), " ".join(w[3:9]) + " um " + " ".join(w[9:15]), " ".join(w[3:9] + ["the"] + w[10:15]), "", None) == []


def test_windows_do_not_cross_documents(spark):
    w = ITEM.split()
    assert found(spark, " ".join(w[:6]), " ".join(w[6:13])) == []


def test_japanese(spark):
    bare = JA.replace("。", "").replace("、", "")
    assert found(spark, "x" + bare[2:26] + "y", bare[2:25], "\n".join(bare[i : i + 5] for i in range(0, 40, 5)), bare[:30].replace("カ", "力").replace("ト", "ﾄ")) == [(0, 2), (2, 2), (3, 2)]


def test_dashes_are_punctuation(spark):
    w = ITEM.split()
    texts = [" ".join(w[3:9]) + dash + " ".join(w[9:15]) for dash in ("\u2014", " \u2013 ", "&mdash;", "\u2012", "\u2015", " \u2212 ", "\u2500\u2500")]
    assert found(spark, *texts) == [(i, 1) for i in range(len(texts))]
    texts = [JA[:7] + JA[7:26].replace("。", dash) for dash in ("――", "\u2014", "\u2500", "&mdash;", " \u2013 ")]  # after kana
    texts.append(JA[:10] + "――" + JA[10:26])  # after a kanji
    assert found(spark, *texts) == [(i, 2) for i in range(len(texts))]


def test_dashes_of_items_and_long_vowel_marks(spark):
    ja = "コーヒーを飲みながら図書館で古い本を読む人が多いと店の人は話しました"
    items = [(1, ITEM.replace("later", "later\u2014and")), (2, ja), (3, "so much of it, of course\u2014then nothing")]
    doc = ITEM.replace("later", "later, and")
    texts = [doc, ja.replace("ー", "\u2015"), ja[:14] + "\u2014" + ja[14:], ja.replace("ー", "\u2015")[:10] + "\u2014" + ja[10:], "it of coursethennothing very so much of it of course then nothing"]
    assert rows(G.leaks(*frames(spark, enumerate(texts), items))) == [(0, 1), (1, 2), (2, 2), (3, 2)]


def test_copies_empty_long_and_clashing_columns(spark):
    d, i = frames(spark, [(1, ITEM), (2, ITEM), (3, "the cat sat. " * 30_000 + ITEM)])
    d, i = d.selectExpr("*", "1 as item_id", "2 as h"), i.selectExpr("*", "3 as doc_id", "4 as kind")
    assert rows(G.leaks(d, i)) == [(1, 1), (2, 1), (3, 1)]
    assert G.leaks(d.limit(0), i).count() == 0 and G.leaks(d, i.limit(0)).count() == 0


def test_reparameterised(spark):
    other = ITEM.replace("Pursalr", "Zidaes").replace("7", "12")
    mixed = ITEM.replace("Pursalr", "Zidaes", 1)
    d, i = frames(spark, [(1, other), (2, ITEM), (3, mixed), (4, "nothing of it")])
    assert [(r.doc_id, r.item_id) for r in G.reparameterised(d, i).collect()] == [(1, 1)]


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{x}" for x in "abcdefgh"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(6)]
    docs = []
    for n in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))]
        src, at = rng.choice(items)[1].split(), rng.randrange(0, 18)
        docs.append((n, " ".join(w + src[at : at + rng.randrange(9, 15)] + w[:5])))
    grams = lambda t: {tuple(t[i : i + 12]) for i in range(len(t) - 11)}
    want = [(n, i) for n, t in docs for i, s in items if grams(t.split()) & grams(s.split())]
    assert rows(G.leaks(*frames(spark, docs, items))) == sorted(want, key=repr)


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"{x}{i}" for x in "abcdefghijklmnop")) for i in range(9)] + [(20, JA)]
    docs = [(i, "so " + t.replace(f"a{i} ", "") if i < 9 else t) for i, t in items]
    want = rows(G.leaks(*frames(spark, docs, items)))
    assert len(want) == 10
    monkeypatch.setattr(G, "MAX_ITEMS", 8)
    assert rows(G.leaks(*frames(spark, docs, items))) == want
    monkeypatch.setattr(G, "MAX_ITEM_CHARS", 100)
    assert rows(G.leaks(*frames(spark, docs, items))) == want


def test_reparameterised_japanese_and_number_of_windows(spark):
    other = JA.replace("ボガイウト", "タロ").replace("ドノセミマ", "サクラコヤナ")
    d, i = frames(spark, [(1, other), (2, JA), (3, JA.replace("ボガイウト", "タロ", 1)), (4, ITEM.replace("Pursalr", "Zidaes").replace("7", "12"))])
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_slots) for r in G.reparameterised(d, i).collect()}
    assert set(got) == {(1, 2), (4, 1)} and got[1, 2][1] == 2 and got[4, 1] == (len(ITEM.split()) - 11, 2)


def test_recall_of_planted_reparameterised_items(spark, data):
    """Every item with its numbers and names changed, one for one, planted in a text; a name stands with a capital
    inside a sentence, or in katakana of at least three letters."""
    import re

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect() if r.text]
    docs = []
    for k, t in items:
        # Long vowels stay: a name of them alone would be no name.
        names = set(re.findall(r"(?<=[a-z,] )[A-Z][a-z]{2,}", t)) | set(re.findall("[ァ-ヴ]{3,}", t))
        numbers = set(re.findall(r"(?<![\w.])\d+(?![\w.])", t))
        new = t
        for n, x in enumerate(sorted(names)):
            new = re.sub(rf"\b{x}\b" if x.isascii() else x, ("Qu" + "bcdfghjklm"[n % 10] + "ovan" + "stvwxyz"[n // 10]) if x.isascii() else "ヌヌ" + "ケセテネヘメレ"[n % 7] * 2, new)
        for n, x in enumerate(sorted(numbers)):
            new = re.sub(rf"(?<![\w.]){x}(?![\w.])", str(7001 + n), new)
        if new != t:
            docs.append((k, "So it was. " + new + " And then." if t.isascii() else new))
    # A text that still shares a window as it stands is a leak, not a re-parameterised question.
    leaked = {r.doc_id for r in G.leaks(*frames(spark, docs, items)).collect()}
    docs = [(k, t) for k, t in docs if k not in leaked]
    found = {(r.doc_id, r.item_id) for r in G.reparameterised(*frames(spark, docs, items)).collect()}
    hit = sum((k, k) in found for k, _ in docs)
    print(f"planted {len(docs)}, found {hit}, others {len(found) - hit}")
    assert len(docs) > 50 and hit >= 0.9 * len(docs)
