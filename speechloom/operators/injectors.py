"""Synthetic disfluencies put into clean sentences, seeded per row so that runs and layouts agree.

A sentence takes one to five insertions at distinct places, each before the word it stems from, so the clean words stay
a subsequence of the result. Slips come from two rules: a function word is taken for another of its closed class, a
content word for another word of the same sentence that begins or ends alike. Only kinds that have a place left in the
sentence are drawn. Classes, hesitations and weights are parameters.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from speechloom.functions.text import FILLERS_CONSERVATIVE, GAP_FILLER_EN

KINDS = ("filler", "repeat", "phrase", "correction", "restart", "fragment", "function", "reading")


@dataclass(frozen=True)
class Style:
    """What an injector draws from. fillers: hesitations; edits: what introduces a correction ('': nothing); classes:
    closed word classes whose members are taken for each other; weights: of KINDS (missing: 1); counts: weights of one to
    five insertions; phrase: weights of repeated phrases by length; least, most: words of a sentence; fragment_least:
    characters of a word that may break off."""

    fillers: tuple[str, ...]
    edits: tuple[str, ...]
    classes: tuple[tuple[str, ...], ...]
    weights: dict[str, float] = field(default_factory=dict)
    counts: tuple[float, ...] = (4, 4, 3, 2, 1)
    phrase: dict[int, float] = field(default_factory=lambda: {2: 2, 3: 1})
    least: int = 3
    most: int = 30
    fragment_least: int = 3


ENGLISH = Style(
    fillers=(GAP_FILLER_EN, "um", "hm"),
    edits=("or rather", "that is", ""),
    classes=(("a", "an", "the"), ("in", "on", "at", "under", "behind"), ("to", "from", "into", "towards"), ("i", "you", "he", "she", "we", "they"), ("me", "him", "her", "us", "them"), ("can", "could", "will", "would", "must", "may"), ("this", "that", "these", "those")),
    least=5,
)
JAPANESE = Style(
    fillers=tuple(f for f in FILLERS_CONSERVATIVE if f.endswith("ー")),
    edits=("というか", "もとい", ""),
    classes=(("は", "が", "も"), ("に", "へ", "で", "まで"), ("を", "と", "から", "より")),
    most=25, fragment_least=2,
)


def kana_reading(word: str) -> str | None:
    """The reading of a word written in kana alone: itself."""
    return word if word and all("ぁ" <= c <= "ヿ" for c in word) else None


def _alike(a: str, b: str) -> bool:
    return a != b and (a[:1] == b[:1] or a[-2:] == b[-2:])


def inject(words: list[str], rng: random.Random, style: Style, reading: Callable[[str], str | None] = kana_reading) -> list[str] | None:
    """words with one to five disfluencies; None for sentences outside the style's lengths."""
    n = len(words)
    if not style.least <= n <= style.most:
        return None
    low = [w.lower() for w in words]
    rivals = [[x for c in style.classes if w in c for x in c if x != w] for w in low]
    slips = [[] if rivals[i] else [words[j] for j in range(n) if not rivals[j] and _alike(low[i], low[j])] for i in range(n)]
    read = [r if (r := reading(w)) and len(r) > 1 else "" for w in words]
    everywhere = list(range(n))
    places = {
        "filler": everywhere, "repeat": everywhere, "phrase": list(range(n - 1)), "restart": list(range(1, n)),
        "correction": [i for i in everywhere if slips[i]], "function": [i for i in everywhere if rivals[i]],
        "fragment": [i for i in everywhere if len(words[i]) >= style.fragment_least], "reading": [i for i in everywhere if read[i]],
    }

    def edited(wrong: str) -> str:
        return f"{wrong} {edit}" if (edit := rng.choice(style.edits)) else wrong

    def head(w: str) -> str:
        return w[: rng.randint(1, max(1, len(w) - 1))]

    put: dict[int, str] = {}
    free = set(everywhere)
    for _ in range(rng.choices(range(1, 6), style.counts)[0]):
        open_places = {k: [i for i in places[k] if i in free and (k != "phrase" or i + 1 in free)] for k in KINDS}
        kinds = [k for k in KINDS if open_places[k] and style.weights.get(k, 1) > 0]
        if not kinds:
            break
        kind = rng.choices(kinds, [style.weights.get(k, 1) for k in kinds])[0]
        i, span = rng.choice(open_places[kind]), 1
        if kind == "phrase":
            lengths = [m for m in style.phrase if i + m <= n and all(j in free for j in range(i, i + m))] or [2]
            span = rng.choices(lengths, [style.phrase.get(m, 1) for m in lengths])[0]
            put[i] = " ".join(words[i : i + span])
        elif kind == "filler":
            put[i] = rng.choice(style.fillers)
        elif kind == "repeat":
            put[i] = " ".join([words[i]] * rng.choice((1, 1, 1, 2)))
        elif kind == "restart":  # the sentence is begun again, and dropped
            put[i] = edited(" ".join(words[: rng.randint(1, min(2, i))]))
        elif kind == "correction":
            put[i] = edited(rng.choice(slips[i]))
        elif kind == "function":
            put[i] = edited(rng.choice(rivals[i]))
        elif kind == "fragment":
            put[i] = head(words[i])
        else:
            put[i] = edited(head(read[i]))
        free -= set(range(i, i + span))
    return [x for i, w in enumerate(words) for x in ([put[i], w] if i in put else [w])]


def injected(words: Column, key: Column, seed: int, style: Style, reading: Callable[[str], str | None] = kana_reading) -> Column:
    """inject of an ARRAY<STRING> as text, drawn from (seed, key); null where nothing could be put in."""

    @F.pandas_udf("string")
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ws, ks in it:
            out = [inject(list(w), random.Random(f"{seed}:{k}"), style, reading) if w is not None else None for w, k in zip(ws, ks)]
            yield pd.Series([None if o is None else " ".join(o) for o in out])

    return run(words, key.cast("string"))
