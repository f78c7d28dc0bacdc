"""Evaluation texts leaking into training text.

Method. Texts are brought to what the eye reads (markup tags, case, punctuation, spacing, line layout and character
variants gone) and to templates: numbers, names and units become typed placeholders. Template windows of items (12
words, or 24 characters of Japanese) are hash-joined to those of the documents. Matching windows are then compared slot
by slot: all slots equal is a leaked passage, slots that differ but map one-to-one a re-parameterised one. As a leaked
Japanese passage is 24 equal characters, its windows are of characters; a re-parameterised one may have names of another
length, so there a run of katakana or of digits is one slot.

Dashes are punctuation, though after kana one may stand for the long vowel mark ー: Japanese texts with dashes are read
every way they can be.

The items are a stated query set, taken in blocks of checked size: their window hashes go to the executors, where each document's windows are
formed by a rolling hash over arrays and only those with an item's hash leave the scan. Nothing of the corpus is
shuffled but these matches. Repeated documents are matched one by one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.lookalikes import plain_text, skeleton
from speechloom.session import small_table, written

WORDS = 12
CHARS = 24
#: Items, and characters of items, whose windows are cut on the driver and held by a task at a time; a larger table is
#: worked through in blocks of items, each against all documents.
MAX_ITEMS, MAX_ITEM_CHARS = 20_000, 8_000_000
#: Characters of text worked on at a time.
CHUNK = 4_000_000

# Units, whose words become one placeholder.
UNITS = frozenset("second seconds minute minutes hour hours day days week weeks month months year years metre metres meter meters km kilometre kilometres kilometer kilometers mile miles gram grams kg kilogram kilograms pound pounds percent dollar dollars euro euros yen ms hz khz".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand".split())

_BLOCK_TAG = re.compile(r"</?(?:p|br|hr|div|li|ul|ol|td|tr|th|table|h[1-6]|blockquote|pre)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_JA = re.compile("[ぁ-ヿ一-鿿]")
_NOT_READ = re.compile(r"[\W_]+")
_DASH = re.compile("[\u2012-\u2015\u2212\u2500]")
#: Dashes that can't be a long vowel mark: not after kana, or several in a row.
_PAUSE = re.compile(f"(?<![ぁ-ゖゝゞァ-ヺー-ヿ]){_DASH.pattern}|{_DASH.pattern}{{2,}}")
_NUM, _NAME, _UNIT, _UNKNOWN = 1, 2, 3, 0
#: What ends a sentence ('' at the start of a text), and what may stand before its first word.
_ENDS, _OPENING = ("", ".", "!", "?", "\n", "…"), " \t\"'(["


def _bare(text: str) -> str:
    """The text without markup."""
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    return html.unescape(text) if "&" in text else text


def read_as_seen(text: str) -> str:
    """The text without markup and in look-alike form, case kept. A dash is a blank unless a kana is before it."""
    text = _bare(text)
    if text.isascii():
        return text
    return skeleton(_PAUSE.sub(" ", plain_text(text)) if _DASH.search(text) else text)


def word_list(text: str) -> list[str]:
    return _WORD.findall(read_as_seen(text))


def char_strings(text: str) -> list[str]:
    """The characters read: one string, or where a dash may be a long vowel mark or punctuation one of each reading (no
    dash is a mark; those after kana are; all are). Texts without Japanese have none."""
    text = plain_text(_bare(text))
    if not _JA.search(text):
        return []
    readings = [text] if not _DASH.search(text) else [_DASH.sub(" ", text), _PAUSE.sub(" ", text), text]
    return list(dict.fromkeys(_NOT_READ.sub("", skeleton(r)).lower() for r in readings))


def _mix(n: np.ndarray) -> np.ndarray:
    """Well spread 64-bit codes of small numbers."""
    n = n.astype(np.uint64)
    with np.errstate(over="ignore"):
        n = (n + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        n ^= n >> np.uint64(27)
        n *= np.uint64(0x94D049BB133111EB)
        return n ^ (n >> np.uint64(31))


def _windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width codes; position i holds the run that begins there."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = h * np.uint64(0x100000001B3) + codes[k : k + n]
    return h ^ (h >> np.uint64(29))


_SLOTS = re.compile("[ァ-ヺー]+|[0-9]+|.")
#: Kinds of windows: words, characters, Japanese slots.
KINDS = (0, 1, 2)


def slots(chars: str) -> list[str]:
    """Characters, with runs of katakana (names) and of digits as one."""
    return _SLOTS.findall(chars)


class Templates:
    """The items' words, names and template windows.

    A word's placeholder depends on the word alone, so equal passages have equal templates: items' words that are
    capitalised wherever they stand, at least once inside a sentence, are names, and so are capitalised words that no
    item has.
    """

    def __init__(self, items: list[tuple[int, str]]) -> None:
        words = [(i, word_list(t)) for i, t in items if t]
        lower, upper, inside = set(), set(), set()
        for _, t in items:
            seen = read_as_seen(t or "")
            for m in _WORD.finditer(seen):
                x = m[0]
                (upper if x[:1].isupper() else lower).add(x.lower())
                if x[:1].isupper() and seen[: m.start()].rstrip(_OPENING)[-1:] not in _ENDS:
                    inside.add(x.lower())
        self.names = (upper & inside) - lower - NUMBERS - UNITS
        self.code = {w: i + 4 for i, w in enumerate(sorted(lower | upper))}
        self.rows: list[tuple[int, int, int, int, str]] = []
        for i, w in words:
            self._add(i, 0, _windows(_mix(np.array([self.placeholder(x) for x in w])), WORDS), [x.lower() for x in w], WORDS, " ")
        for i, t in items:
            for s in char_strings(t or ""):
                self._add(i, 1, _windows(_mix(self.chars(s)), CHARS), s, CHARS, "")
                self._add(i, 2, _windows(_mix(self.slot_codes(u := slots(s))), CHARS), u, CHARS, " ")
        self.hashes = [np.unique(np.array([np.uint64(r[2] & (2**64 - 1)) for r in self.rows if r[1] == kind], np.uint64)) for kind in KINDS]

    def _add(self, item: int, kind: int, hashes: np.ndarray, units: list[str] | str, width: int, joint: str) -> None:
        self.rows += [(item, kind, int(h.astype(np.int64)), p, joint.join(units[p : p + width])) for p, h in enumerate(hashes)]

    def placeholder(self, w: str) -> int:
        low = w.lower()
        if low[:1].isdigit() or low in NUMBERS:
            return _NUM
        if low in UNITS:
            return _UNIT
        if low in self.names:
            return _NAME
        return self.code.get(low) or (_NAME if w[:1].isupper() else _UNKNOWN)

    @staticmethod
    def chars(s: str) -> np.ndarray:
        """Codes of characters: digits as one, katakana (names) as one."""
        c = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64)
        return np.where((c >= 0x30) & (c <= 0x39), _NUM, np.where((c >= 0x30A1) & (c <= 0x30FA), _NAME, c))


    @staticmethod
    def slot_codes(units: list[str]) -> np.ndarray:
        """Codes of slots by their first character."""
        return Templates.chars("".join(u[0] for u in units))


class _Codes(dict):
    """Placeholders of words met, kept while few."""

    def __init__(self, of: Templates) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = code = self.of.placeholder(w)
        return code


class Finder:
    """Windows of documents that have an item's template."""

    def __init__(self, templates: Templates) -> None:
        self.templates, self.codes = templates, _Codes(templates)
        self.maybe = []
        for h in templates.hashes:
            seen = np.zeros(1 << 20, bool)
            seen[(h >> np.uint64(44)).astype(np.int64)] = True
            self.maybe.append(seen)

    def _hits(self, codes: np.ndarray, kind: int, width: int) -> np.ndarray:
        h = _windows(_mix(codes), width)
        at = np.flatnonzero(self.maybe[kind][(h >> np.uint64(44)).astype(np.int64)])
        if len(at) and len(self.templates.hashes[kind]):
            known = self.templates.hashes[kind]
            at = at[known[np.minimum(np.searchsorted(known, h[at]), len(known) - 1)] == h[at]]
        return np.stack([at, h[at].astype(np.int64)], 1) if len(at) else np.empty((0, 2), np.int64)

    def find(self, texts: list[str], kinds: tuple[int, ...] = (0, 1)) -> list[tuple[int, int, int, int, str]]:
        """(text's number, kind, hash, position, literal) of each matching window of the kinds (0 is always searched)."""
        out = []
        words = [word_list(t) for t in texts]
        starts = np.cumsum([0, *map(len, words)])
        flat = np.fromiter((self.codes[w] for ws in words for w in ws), np.int64, starts[-1])
        for at, h in self._hits(flat, 0, WORDS).tolist():
            d = int(np.searchsorted(starts, at, "right")) - 1
            p = at - int(starts[d])
            if p + WORDS <= len(words[d]):
                out.append((d, 0, h, p, " ".join(words[d][p : p + WORDS]).lower()))
        ja = [(d, s) for d, t in enumerate(texts) if not t.isascii() for s in char_strings(t)]
        if 1 in kinds:
            starts = np.cumsum([0, *(len(s) for _, s in ja)])
            for at, h in self._hits(self.templates.chars("".join(s for _, s in ja)), 1, CHARS).tolist():
                k = int(np.searchsorted(starts, at, "right")) - 1
                p = at - int(starts[k])
                if p + CHARS <= len(ja[k][1]):
                    out.append((ja[k][0], 1, h, p, ja[k][1][p : p + CHARS]))
        if 2 in kinds:
            cut = [slots(s) for _, s in ja]
            starts = np.cumsum([0, *map(len, cut)])
            for at, h in self._hits(self.templates.slot_codes([u for us in cut for u in us]), 2, CHARS).tolist():
                k = int(np.searchsorted(starts, at, "right")) - 1
                p = at - int(starts[k])
                if p + CHARS <= len(cut[k]):
                    out.append((ja[k][0], 2, h, p, " ".join(cut[k][p : p + CHARS])))
        return out


def template_matches(documents: DataFrame, items: DataFrame, kinds: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Windows shared as templates: doc_id, item_id, kind (0 words, 1 characters, 2 Japanese slots), doc_pos, item_pos,
    doc_words, item_words (the literal windows). Characters' positions are those of a reading; a text with several may
    repeat a window.

    documents: doc_id, text. items: item_id, text. Null and empty texts have no windows.
    """
    items = items.select(F.col("item_id").cast("bigint"), "text").filter("item_id is not null and text is not null")
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-2 * size["n"] // MAX_ITEMS) if size["n"] > MAX_ITEMS else 1, -(-size["chars"] // MAX_ITEM_CHARS))
    found = [_block_matches(documents, items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), kinds) for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _block_matches(documents: DataFrame, items: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """template_matches for one block of items."""
    spark = documents.sparkSession
    made = Templates([(r[0], r[1]) for r in small_table(items, MAX_ITEMS)])
    windows, made.rows = [r for r in made.rows if r[1] in kinds], []  # tasks need the hashes only
    sent = spark.sparkContext.broadcast(made)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(sent.value)

        def search(ids: list[int], texts: list[str]) -> pd.DataFrame:
            hits = finder.find(texts, kinds)
            return pd.DataFrame({"doc_id": [ids[h[0]] for h in hits], **{n: [h[i] for h in hits] for i, n in ((1, "kind"), (2, "h"), (3, "doc_pos"), (4, "doc_words"))}}).astype({"doc_id": "int64", "kind": "int32", "h": "int64", "doc_pos": "int32", "doc_words": "str"})

        for df in it:
            ids, texts, n = [], [], 0
            for i, t in zip(df["doc_id"].tolist(), df["text"].tolist()):
                ids.append(i)
                texts.append(t)
                n += len(t)
                if n > CHUNK:
                    yield search(ids, texts)
                    ids, texts, n = [], [], 0
            if ids:
                yield search(ids, texts)

    found = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, "doc_id bigint, kind int, h bigint, doc_pos int, doc_words string")
    table = spark.createDataFrame(pd.DataFrame(windows, columns=["item_id", "kind", "h", "item_pos", "item_words"]).astype({"kind": "int32", "item_pos": "int32"}), "item_id bigint, kind int, h bigint, item_pos int, item_words string")
    return found.join(table, ["kind", "h"]).select("doc_id", "item_id", "kind", "doc_pos", "item_pos", "doc_words", "item_words")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents and the items that leaked into them: doc_id, item_id (distinct); all slots of a window are equal."""
    return template_matches(documents, items).filter("doc_words = item_words").select("doc_id", "item_id").distinct()


def reparameterised(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with an item's passage under other numbers, names or units: doc_id, item_id, n_windows (places of the
    document with one of its templates), n_slots (differing slots).

    Only pairs whose differing words map one-to-one over all their shared windows, and that are no leak, count. English
    names are told by their capitals, Japanese ones by katakana.
    """
    m = written(template_matches(documents, items, (0, 2)), "matches")
    whole = m.groupBy("doc_id", "item_id").agg(F.max(F.col("doc_words") == F.col("item_words")).alias("same"), F.countDistinct("doc_pos").alias("n_windows"))
    slot = m.select("doc_id", "item_id", F.explode(F.arrays_zip(F.split("doc_words", " ").alias("d"), F.split("item_words", " ").alias("i"))).alias("s")).select("doc_id", "item_id", "s.*").distinct()
    per = slot.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("d").alias("ds"), F.countDistinct("i").alias("is"), F.count_if(F.col("d") != F.col("i")).alias("n_slots"))
    return per.filter("pairs = ds and pairs = `is` and n_slots > 0").join(whole.filter("not same"), ["doc_id", "item_id"]).select("doc_id", "item_id", "n_windows", "n_slots")
