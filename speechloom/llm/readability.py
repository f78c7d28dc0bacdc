"""Reading level of each document, in English and Japanese.

Method. A familiar-word formula: level = a + b x (share of words outside the high-frequency list) + c x (average sentence
length). The high-frequency list comes from the document frequencies of the corpus, all documents counted. As a corpus
may be full of demanding texts, whose words are then frequent too, frequencies are taken apart for documents that look
easy and demanding by the length of their words (English) or their share of kanji (Japanese): a word is on the list if
it is frequent among the easy ones and not more so among the others. The weights are fitted to the raters' levels by
ridge regression towards fixed ones, on at most MAX_RATED rated documents.

Words are runs of letters, apostrophes and hyphens in English and character pairs in Japanese, look-alike characters made plain. Sentences end at
stops that aren't abbreviations; a sentence of any length is measured if it is punctuated. What runs on for more than
RUN_ON words without any mark, or ends without a stop, is unpunctuated and not measured, and a document without a
measured sentence takes the corpus mean.

Texts are cut in Arrow batches: cutting with built-in regex functions took five times the CPU. The frequency pass counts
inside each task and shuffles one row per word and task; the scoring pass shuffles nothing. The list holds the MAX_LIST
most frequent of the words in at least MIN_SHARE of the easy documents, whatever the corpus size, and goes to the
executors as one broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.lookalikes import plain_text, skeleton

#: Rated documents the weights are fitted on, by lowest hash of doc_id.
MAX_RATED = 20_000
#: A word of the high-frequency list is in so many of the easy documents; the list is as long as this at most, as any
#: list of familiar words has a length.
MIN_SHARE = 0.001
MAX_LIST = 400_000
#: Words a task counts before it passes the counts on.
MAX_COUNTED = 400_000
#: Longest stretch without any punctuation in a measured sentence: words (English), characters (Japanese).
RUN_ON = {False: 35, True: 80}
DEMANDING = 3.5
MIN_WORDS, MIN_CHARS = 40, 100
#: Rated documents need so many words to be fitted on.
MIN_RATED_WORDS = 20
#: Strength of the fixed weights, in rated documents.
PRIOR = 4.0
#: First guess by word length or kanji share, and the formula's weights: intercept, slope(s); by whether Japanese.
GUESS = {False: (-0.7, 0.7), True: (1.0, 4.2)}
WEIGHTS = {False: (1.4, 2.2, 0.05), True: (1.4, 2.2, 0.02)}
SCALE = {False: (1.0, 1.0, 0.05), True: (1.0, 1.0, 0.02)}
#: Spread of levels that any class of ratings has at least.
MIN_SPREAD = 0.2
ABBREVIATIONS = frozenset("cf fig figs approx etc vs e.g i.e dr mr mrs prof no al eq sec vol p pp s".split())

_JA = re.compile("[ぁ-ヿ一-鿿]+")
_KANJI = re.compile("[一-鿿]+")
_LAYOUT = re.compile(r"<[^<>]*>|&\w{2,8};|^\s*(?:[A-Z]:|[-*|]) ", re.M)
_WORD = re.compile(r"[a-z'\-]+")
#: ASCII characters that words are made of; all others become blanks.
_TO_WORDS = {c: " " for c in range(128) if chr(c) not in "abcdefghijklmnopqrstuvwxyz'-"}
_END = re.compile(r"[.!?]+[\"'”)\]]*(?=\s|$)")
_JA_END = re.compile("[。！？．.!?]+")
_MARK = {False: re.compile(r"[,;:()]| [-/–—] "), True: re.compile("[、，,;；:：（）()]")}


@dataclass
class Profile:
    ja: bool
    size: int
    words: list[str]
    guess_at: float | None
    sentence: float | None


def _measured(piece: str, ja: bool) -> int:
    """Length of a sentence, 0 if it is empty or looks unpunctuated."""
    n = len(piece) if ja else len(piece.split())
    if n > RUN_ON[ja] and max(len(x) if ja else len(x.split()) for x in _MARK[ja].split(piece)) > RUN_ON[ja]:
        return 0
    return n


def profile(text: str) -> Profile:
    """Language, size, words, mean word length or kanji share, and average measured sentence length of a text."""
    plain = text
    if not text.isascii():
        solid = "".join(plain_text(text).split())
        runs = _JA.findall(solid)
        marks = sum(map(len, runs))
        if marks * 2 > len(solid):
            words = [r[i : i + 2] for r in runs for i in range(len(r) - 1)]
            lengths = [n for s in _JA_END.split(solid)[:-1] if (n := _measured(s, True))]
            return Profile(True, len(text), words, sum(map(len, _KANJI.findall(solid))) / marks, sum(lengths) / len(lengths) if lengths else None)
        plain = skeleton(text)
    if "\n" in plain or "<" in plain or "&" in plain or _LAYOUT.match(plain):
        plain = _LAYOUT.sub(" ", plain)
    low = plain.lower()
    words = low.translate(_TO_WORDS).split() if low.isascii() else _WORD.findall(low)
    total, n, at = 0, 0, 0
    for m in _END.finditer(plain):
        word = plain[plain.rfind(" ", 0, m.start()) + 1 : m.start()].lower().lstrip("(\"'[\n")
        if word in ABBREVIATIONS:
            continue
        if k := _measured(plain[at : m.start()], False):
            total, n = total + k, n + 1
        at = m.end()
    return Profile(False, len(text.split()), words, len("".join(words)) / len(words) if words else None, total / n if n else None)


def fit(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...], scale: tuple[float, ...], strength: float = PRIOR) -> tuple[float, ...]:
    """Ridge regression of y on (1, x) towards prior; scale: typical size of each weight. Without rows: prior."""
    s, p = np.array(scale), np.array(prior)
    a = np.column_stack([np.ones(len(y)), x.reshape(len(y), len(prior) - 1)]) * s
    w = np.linalg.solve(a.T @ a + strength * np.eye(len(p)), a.T @ (y - a @ (p / s)))
    return tuple(float(v) for v in (w + p / s) * s)


@dataclass
class Model:
    """Weights, mean measured sentence, least level that counts as demanding and high-frequency list, by whether
    Japanese."""

    guess: dict[bool, tuple[float, ...]] = field(default_factory=lambda: dict(GUESS))
    weights: dict[bool, tuple[float, ...]] = field(default_factory=lambda: dict(WEIGHTS))
    sentence: dict[bool, float] = field(default_factory=lambda: {False: 15.0, True: 30.0})
    cut: dict[bool, float] = field(default_factory=lambda: {False: DEMANDING, True: DEMANDING})
    familiar: dict[bool, frozenset[str]] = field(default_factory=lambda: {False: frozenset(), True: frozenset()})

    def looks_hard(self, p: Profile) -> bool:
        return p.guess_at is not None and self.guess[p.ja][0] + self.guess[p.ja][1] * p.guess_at >= DEMANDING

    def features(self, p: Profile) -> tuple[float, float]:
        known = self.familiar[p.ja]
        return (1 - sum(map(known.__contains__, p.words)) / len(p.words) if p.words else 0.0), (self.sentence[p.ja] if p.sentence is None else p.sentence)

    def level(self, p: Profile) -> tuple[float, float]:
        """(share of unfamiliar words, level)."""
        unfamiliar, sentence = self.features(p)
        a, b, c = self.weights[p.ja]
        return unfamiliar, a + b * unfamiliar + c * sentence


def _frequencies(documents: DataFrame, model: Model) -> DataFrame:
    """ja, word, in_hard, in_easy, sentences, measured over all documents; the row of word null counts the documents
    themselves and sums their average sentences."""

    def run(it: Iterator[pd.DataFrame], m: Model = model) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[bool, bool], Counter] = {(j, h): Counter() for j in (False, True) for h in (False, True)}
        measured = {False: [0.0, 0], True: [0.0, 0]}

        def out() -> pd.DataFrame:
            rows = [(j, w, n * h, n * (not h), 0.0, 0) for (j, h), c in counts.items() for w, n in c.items()]
            rows += [(j, None, 0, 0, *measured[j]) for j in measured]
            for c in counts.values():
                c.clear()
            for j in measured:
                measured[j] = [0.0, 0]
            return pd.DataFrame(rows, columns=["ja", "word", "in_hard", "in_easy", "sentences", "measured"])

        for df in it:
            for t in df["text"]:
                p = profile(t)
                if not p.words:
                    continue
                c = counts[p.ja, m.looks_hard(p)]
                c.update(set(p.words))
                c[None] += 1
                if p.sentence is not None:
                    measured[p.ja][0] += p.sentence
                    measured[p.ja][1] += 1
            if sum(map(len, counts.values())) > MAX_COUNTED:
                yield out()
        yield out()

    parts = documents.filter("text is not null").select("text").mapInPandas(run, "ja boolean, word string, in_hard bigint, in_easy bigint, sentences double, measured bigint")
    return parts.groupBy("ja", "word").agg(*[F.sum(c).alias(c) for c in ("in_hard", "in_easy", "sentences", "measured")])


def train(documents: DataFrame, levels: DataFrame, max_rated: int = MAX_RATED) -> Model:
    """Fit the list and the weights. documents: doc_id, text; levels: doc_id, reading_level (nulls are left out;
    several raters of a document are averaged)."""
    spark, model = documents.sparkSession, Model()
    rated = levels.filter("doc_id is not null and reading_level is not null").groupBy("doc_id").agg(F.avg("reading_level").alias("level")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    rated = spark.createDataFrame([tuple(r) for r in rated.collect()], "doc_id bigint, level double")  # at most max_rated rows

    def measured(it: Iterator[pd.DataFrame], sent: Broadcast | None) -> Iterator[pd.DataFrame]:
        known = sent.value if sent else None
        for df in it:
            rows = []
            for t, level in zip(df["text"], df["level"]):
                p = profile(t)
                if len(p.words) >= MIN_RATED_WORDS:
                    rows.append((p.ja, p.guess_at, *(known.features(p) if known else (0.0, 0.0)), level))
            yield pd.DataFrame(rows, columns=["ja", "guess_at", "unfamiliar", "sentence", "level"])

    sample = documents.filter("text is not null").select("doc_id", "text").join(F.broadcast(rated), "doc_id").select("text", "level").persist()

    def collect(sent: Broadcast | None) -> dict[bool, np.ndarray]:
        rows = sample.mapInPandas(lambda it: measured(it, sent), "ja boolean, guess_at double, unfamiliar double, sentence double, level double").collect()
        return {j: np.array([tuple(r)[1:] for r in rows if r["ja"] == j], float).reshape(-1, 4) for j in (False, True)}

    for j, z in collect(None).items():
        model.guess[j] = fit(z[:, 0], z[:, 3], GUESS[j], (1.0, 4.0 if j else 1.0))
    frequency = _frequencies(documents, model).persist()
    try:
        totals = {r["ja"]: r for r in frequency.filter("word is null").collect()}
        of = lambda c: F.when(F.col("ja"), F.lit(max(1, totals[True][c]) if True in totals else 1)).otherwise(F.lit(max(1, totals[False][c]) if False in totals else 1))
        listed = frequency.filter("word is not null and in_easy >= 2").filter((F.col("in_easy") >= MIN_SHARE * of("in_easy")) & (F.col("in_easy") / of("in_easy") >= F.col("in_hard") / of("in_hard")))
        words = listed.orderBy(F.desc("in_easy"), "word").select("ja", "word").limit(MAX_LIST).collect()
    finally:
        frequency.unpersist()
    for j in (False, True):
        model.familiar[j] = frozenset(r["word"] for r in words if r["ja"] == j)
        if j in totals and totals[j]["measured"]:
            model.sentence[j] = totals[j]["sentences"] / totals[j]["measured"]
    for j, z in collect(spark.sparkContext.broadcast(model)).items():
        model.weights[j] = fit(z[:, 1:3], z[:, 3], WEIGHTS[j], SCALE[j])
        # A fitted line flattens the ends: the cut lies between what documents rated about 3 and about 4 get (medians, as
        # raters err), nearer to the one with the smaller spread. PRIOR documents of the nominal level keep it steady.
        said, w = np.column_stack([np.ones(len(z)), z[:, 1:3]]) @ np.array(model.weights[j]), z[:, 3]
        near = [np.concatenate([said[(w >= lo - 0.5) & (w < lo + 0.5)], np.full(int(PRIOR), lo)]) for lo in (3.0, 4.0)]
        middle = [float(np.median(x)) for x in near]
        spread = [float(np.median(np.abs(x - m))) + MIN_SPREAD for x, m in zip(near, middle)]
        model.cut[j] = middle[0] + (middle[1] - middle[0]) * spread[0] / sum(spread)
    sample.unpersist()
    return model


def reading_levels(documents: DataFrame, levels: DataFrame) -> DataFrame:
    """doc_id, ja, size (characters if ja, else words at white space), unfamiliar, sentence (null: none measured),
    level, demanding (level 4 or 5) of every document with text.

    Null texts are left out; empty texts have size 0 and the level of no unfamiliar word. Repeated doc_ids are levelled
    one by one; further columns are ignored. Empty tables: empty result.
    """
    documents = documents.select("doc_id", "text")
    model = train(documents, levels)

    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for df in it:
            rows = []
            for t in df["text"]:
                p = profile(t)
                unfamiliar, level = m.level(p)
                rows.append((p.ja, p.size, unfamiliar, p.sentence, level, level >= m.cut[p.ja]))
            out = pd.DataFrame(rows, columns=["ja", "size", "unfamiliar", "sentence", "level", "demanding"])
            out.insert(0, "doc_id", df["doc_id"].to_numpy())
            yield out

    return documents.filter("doc_id is not null and text is not null").mapInPandas(run, "doc_id bigint, ja boolean, size int, unfamiliar double, sentence double, level double, demanding boolean")


def demanding(documents: DataFrame, levels: DataFrame) -> DataFrame:
    """doc_id of documents of at least MIN_WORDS words or MIN_CHARS characters that read at level 4 or 5."""
    long = F.col("size") >= F.when(F.col("ja"), MIN_CHARS).otherwise(MIN_WORDS)
    return reading_levels(documents, levels).filter(long & F.col("demanding")).select("doc_id").distinct()
