"""Text that looks alike in one consistent form.

Method. Each letter has a set of scripts it can be resolved to: its own, and those that hold a letter of the same shape.
The sets are intersected over a token: an empty intersection of the letters' own scripts means a mixed token, a
non-empty intersection of the resolved sets that excludes the own script a whole-script confusable. The token is then
spelled in a script all its letters can take; among several the known spelling (a lexicon's) decides, else the script
most of its letters have. Invisible characters go, compatibility forms (full and half width, ligatures, radicals),
blanks, apostrophes and combining marks take their plain composed form.

Letters of the same shape come from the fixed tables below and, beyond them, from the Unicode table of confusable
characters in the ICU library that Spark ships, as far as they look like a Latin letter.

Skeletons serve as join keys: two texts look alike if their skeletons are equal. Only words that are not already plain
leave the JVM.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zipfile
from collections import Counter
from collections.abc import Iterator
from importlib.util import find_spec
from itertools import groupby
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.session import small_table

# Letters of the same shape, by script, each with the Latin or Katakana letter that stands for its group.
CYRILLIC_LIKE = dict(zip("асеіорѕхуһјԁԛԝѵүАВСЕНІЈКМОРЅТХҮ", "aceiopsxyhjdqwvyABCEHIJKMOPSTXY"))
GREEK_LIKE = dict(zip("αονιυγρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aoviuypABEZHIKMNOPTYX"))
LATIN_OTHER = {"ɡ": "g", "ɑ": "a", "ı": "i", "ո": "n", "օ": "o", "ѡ": "w", "ƅ": "b", "ӏ": "l", "ⅼ": "l", "ք": "p", "ս": "u", "ց": "g", "հ": "h"}
KANA_HAN = dict(zip("タニカロハエトオノヒムメチミセリヘベペー", "夕二力口八工卜才丿匕厶乂千三世りへべぺ一"))
DASHES_LIKE_CHOON = "\u2015\u2014\u2500\u3161\uff0d\u2012\u2013\u2212"
APOSTROPHES = "\u2019\u2018\u02bc\u2032\uff07\u02b9\u00b4`\u02bb\u02bd\u02c8\u201b"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters without a picture of their own (as a regex class): format characters, joiners, variation selectors, fillers.
INVISIBLE = r"\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufffb\U000e0000-\U000e0fff"

_ODD_BLANKS = re.compile(rf" *[{re.escape(BLANKS)}][ {re.escape(BLANKS)}]*")
_INVISIBLE = re.compile(rf"[{INVISIBLE}]+")
_ODD = re.compile(rf"[{INVISIBLE}{re.escape(APOSTROPHES + BLANKS)}]")
_BLANKS = str.maketrans(dict.fromkeys(BLANKS, " "))
_APOSTROPHES = str.maketrans(dict.fromkeys(APOSTROPHES, "'"))
#: Scripts whose letters are spelled one for one in another of them.
ALPHABETS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE", "LISU", "COPTIC")


_SCRIPTS: dict[str, str] = {}  # what script_of and _scripts_of found; at most one entry a character
_ABLE: dict[str, tuple[str, frozenset[str]]] = {}


def script_of(c: str) -> str:
    """First word of the letter's Unicode name, that of its plain form where it is a compatibility form; '' for what
    belongs to no script (marks, digits, signs)."""
    if (s := _SCRIPTS.get(c)) is None:
        plain = unicodedata.normalize("NFKC", c)
        s = _SCRIPTS[c] = unicodedata.name(plain[:1] or c, "").split(" ")[0] if unicodedata.category(c)[0] == "L" else ""
    return s


def _icu_jars() -> list[Path]:
    """ICU libraries among Spark's jars: of SPARK_HOME, and beside the package; a worker has that as python/lib/pyspark.zip
    in Spark's home."""
    package = Path(find_spec("pyspark").origin).parent
    homes = [Path(h) for h in (os.environ.get("SPARK_HOME"),) if h] + [package, *package.parents]
    return [j for h in homes for j in sorted((h / "jars").glob("icu4j-*.jar"), reverse=True)]


def unicode_prototypes() -> dict[str, str]:
    """The Unicode table of confusable characters, character -> prototype, from the ICU library that Spark ships. Without
    it fewer texts would be found, so it must be there: raises if it isn't."""
    if not (jars := _icu_jars()):
        raise RuntimeError("no icu4j among Spark's jars: look-alike characters need its Unicode table; set SPARK_HOME")
    with zipfile.ZipFile(jars[0]) as z:
        raw = z.read("com/ibm/icu/impl/data/icudata/confusables.cfu")
    raw = raw[int.from_bytes(raw[:2], "big") :]  # after ICU's own header
    head = [int.from_bytes(raw[4 * i : 4 * i + 4], "big") for i in range(9)]
    (keys, n), (index, m), (strings, k) = head[3:5], head[5:7], head[7:9]
    text = raw[strings : strings + 2 * k].decode("utf-16-be", "replace")
    out = {}
    for i in range(min(n, m)):
        key = int.from_bytes(raw[keys + 4 * i : keys + 4 * i + 4], "big")
        at, length = int.from_bytes(raw[index + 2 * i : index + 2 * i + 2], "big"), (key >> 24) + 1
        out[chr(key & 0xFFFFFF)] = chr(at) if length == 1 else text[at : at + length]
    return out


def _latin_shape(c: str, prototype: str) -> str | None:
    """The ASCII letter that stands for a letter's group: its prototype, or the letter whose small capital that is."""
    if len(prototype) != 1 or unicodedata.category(c)[0] != "L" or script_of(c) not in ALPHABETS or unicodedata.normalize("NFKC", c) != c:
        return None
    if prototype.isascii() and prototype.isalpha():
        return "I" if prototype == "l" and c.isupper() else prototype
    small = re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])|LATIN SMALL LETTER (K)RA|LATIN SMALL LETTER TURNED (W)", unicodedata.name(prototype, ""))
    return {"w": "m"}.get(x := (small[1] or small[2] or small[3]).lower(), x) if small else None


_FIXED = CYRILLIC_LIKE | GREEK_LIKE | LATIN_OTHER | {"п": "n"}
_FOUND = {c: x for c, p in unicode_prototypes().items() if not c.isascii() and c not in _FIXED and (x := _latin_shape(c, p))}
_SHAPES: dict[str, str] = _FOUND | _FIXED | {v: k for k, v in KANA_HAN.items()} | dict.fromkeys(DASHES_LIKE_CHOON, "ー")
_SKELETON = str.maketrans(_SHAPES)
#: What a skeleton may change: letters of a group, and composed letters, whose base may be one.
_SHAPED = re.compile("[" + "".join(_SHAPES) + "\u00c0-\u024f\u0370-\u03ff\u0400-\u04ff\u1e00-\u1fff\u3041-\u30ff]")
_ALPHABETIC = re.compile("[A-Za-z\u00c0-\u024f\u0250-\u02af\u0300-\u058f\u13a0-\u13ff\u1e00-\u1fff\u2c80-\u2cff\ua4d0-\ua4ff\uab70-\uabbf]+")
#: Spellings of a group by script; those of the fixed tables first.
_SPELLINGS: dict[str, dict[str, str]] = {}
for _o, _l in (_FIXED | _FOUND).items():
    _SPELLINGS.setdefault(_l, {"LATIN": _l}).setdefault(script_of(_o), _o)
#: Kana and Han are one writing system: a letter takes the kind of its neighbours.
_KIND = {**{k: ("KATAKANA", k) for k in KANA_HAN}, **{v: ("HIRAGANA" if v in "りへべぺ" else "CJK", k) for k, v in KANA_HAN.items()}}


def plain_text(s: str) -> str:
    """Invisible characters gone; compatibility forms, blanks, apostrophes and combining marks plain (NFKC)."""
    if _ODD.search(s):
        s = _INVISIBLE.sub("", s)
        # Apostrophe-like signs go first: some have a compatibility form with a blank in it.
        s = s.translate(_APOSTROPHES).translate(_BLANKS)
    return s if s.isascii() or unicodedata.is_normalized("NFKC", s) else unicodedata.normalize("NFKC", s)


def skeleton(s: str) -> str:
    """Key that is equal for texts that look alike. Accents count: they are part of the look."""
    s = plain_text(s)
    if not _SHAPED.search(s):
        return s
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(_SKELETON))


def _scripts_of(c: str) -> tuple[str, frozenset[str]]:
    """(script of a letter, scripts that have a letter of its shape)."""
    if (found := _ABLE.get(c)) is None:
        own = script_of(c)
        found = _ABLE[c] = (own, frozenset({own, *_SPELLINGS.get(_SHAPES.get(c, c), {})}))
    return found


def resolved_scripts(token: str) -> tuple[set[str], set[str]]:
    """(scripts of the letters, scripts in which the whole token can be spelled). More than one of the first: mixed;
    others than the first in the second: whole-script confusable."""
    own, able = set(), None
    for c in unicodedata.normalize("NFD", token):
        s, can = _scripts_of(c)
        if s:
            own.add(s)
            able = can if able is None else able & can
    return own, set(able or ())


def spelled_in(token: str, script: str) -> str:
    """A token (plain_text) with its letters of other scripts spelled in this one, where they have a shape in it."""
    return unicodedata.normalize("NFC", "".join(_SPELLINGS.get(_SHAPES.get(c, c), {}).get(script, c) if script_of(c) not in ("", script) or c in LATIN_OTHER else c for c in unicodedata.normalize("NFD", token)))


def unify_script(token: str, known: dict[str, str] | None = None) -> str:
    """The token in one consistent script. known: plain spelling by skeleton. A known form holds (the token's edges are
    kept out) if it is in a script that the letters' resolved sets have in common; Japanese writing, in which scripts mix,
    is looked up by its look alone. Without a known spelling a token all of one script stays, and a mixed one is spelled
    in the script it can all take (Latin if it has Latin letters, else the one most of its letters have)."""
    t = plain_text(token)
    own, able = resolved_scripts(t)
    mixed, whole = len(own) > 1, bool(able - own)
    alphabetic = not own.isdisjoint(ALPHABETS)
    if known and (mixed or whole or not t.isascii()) and (form := known.get(skeleton(t).strip())) is not None:
        # The form's own script is one that all letters of the token can take.
        if not alphabetic or any(script_of(c) in able for c in form):
            return form
    if t.isascii():
        return t
    if alphabetic:
        if not mixed or not able:
            return t
        count = Counter(script_of(c) for c in t)
        to = "LATIN" if "LATIN" in own & able else max(sorted(able), key=lambda s: count[s])
        return spelled_in(t, to)
    return "".join(_by_neighbours(t, i) for i in range(len(t)))


def _by_neighbours(t: str, i: int) -> str:
    """Letter i in the kind of the kana and Han next to it."""
    c = t[i]
    kind, shape = _KIND.get(c, (None, _SHAPES.get(c)))
    if kind is None and shape != "ー":
        return c
    near = {script_of(x) if x != "ー" else "KATAKANA" for x in (t[max(0, i - 1) : i] + t[i + 1 : i + 2])}
    if "KATAKANA" in near and kind != "KATAKANA" and (kind != "HIRAGANA" or "HIRAGANA" not in near):
        return shape
    if kind == "KATAKANA" and near == {"HIRAGANA"} and KANA_HAN[c] in "りへべぺ":
        return KANA_HAN[c]
    return c


def _plain_blanks(text: str) -> str:
    """plain_text in which a run of blanks with one other than U+0020 is the joint of words: one U+0020, between letters
    of unspaced writing and at the text's edges nothing."""
    if not _ODD_BLANKS.search(text):
        return plain_text(text)
    parts = [p for p in map(plain_text, _ODD_BLANKS.split(_INVISIBLE.sub("", text))) if p]
    joints = ["" if _is_unspaced(a[-1]) and _is_unspaced(b[0]) else " " for a, b in zip(parts, parts[1:])]
    return "".join(p + j for p, j in zip(parts, [*joints, ""]))


def unify_text(text: str, lexicon: Lexicon | None = None) -> str:
    """The text with plain blanks and each token in one script; unspaced ones are cut into the lexicon's forms."""
    one = lexicon.plain if lexicon else unify_script
    return "".join(t if t.isspace() or t.isascii() else one(t) for t in re.split(r"(\s+)", _plain_blanks(text)))


def _is_unspaced(token: str) -> bool:
    return any(script_of(c) in ("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA") for c in token)


class Lexicon:
    """Forms by skeleton, and the segmentation of unspaced text into forms."""

    def __init__(self, forms: list[str]) -> None:
        self.forms = set(forms)
        self.by_skeleton: dict[str, str] = {}
        for f in sorted(forms):
            self.by_skeleton.setdefault(skeleton(f), f)
        self.longest = max(map(len, [*forms, *self.by_skeleton]), default=0)

    def _cut(self, t: str) -> list[tuple[str, bool]]:
        """(piece, whether it is a form) of t: forms, in their own spelling, wherever a stretch looks like one. Of all
        cuts one with the fewest characters left over, then the fewest changed, then the fewest forms."""
        bones, units = skeleton(t), list(t)
        ends = list(range(len(t) + 1))
        if len(bones) != len(t):
            # Letters with their marks: a skeleton may compose what the text can't.
            units = []
            for c in t:
                if units and unicodedata.combining(c):
                    units[-1] += c
                else:
                    units.append(c)
            ends = [0]
            for u in units:
                ends.append(ends[-1] + len(skeleton(u)))
        n = len(units)
        changed, left = n + 1, (n + 1) * (n + 1)
        best, back = [0] * (n + 1), [(0, "")] * (n + 1)
        for i in range(1, n + 1):
            best[i], back[i] = best[i - 1] + left, (i - 1, "")
            for k in range(max(0, i - self.longest), i):
                if best[k] < best[i] and (form := self.by_skeleton.get(bones[ends[k] : ends[i]])) is not None:
                    at = best[k] + 1
                    if (old := "".join(units[k:i])) in self.forms:
                        form = old
                    elif form != old:
                        at += changed * max(1, sum(a != b for a, b in zip(form, old)))
                    if at < best[i]:
                        best[i], back[i] = at, (k, form)
        pieces, i = [], n
        while i:
            k, form = back[i]
            pieces.append((form or units[k], form != ""))
            i = k
        return pieces[::-1]

    def plain(self, token: str) -> str:
        """unify_script of a token (plain_text); one of unspaced writing that is no form is cut into forms, and what is
        left over between them takes the kind of its neighbours."""
        if token in self.forms:
            return token
        if skeleton(token).strip() in self.by_skeleton or not _is_unspaced(token):
            return unify_script(token, self.by_skeleton)
        pieces = self._cut(token)
        whole, out, at = "".join(p for p, _ in pieces), [], 0
        for known, run in groupby(pieces, lambda p: p[1]):
            text = "".join(p for p, _ in run)
            if not known:
                near = "".join(_by_neighbours(whole, i) for i in range(at, at + len(text)))
                out.append(_ALPHABETIC.sub(lambda m: unify_script(m[0], self.by_skeleton), near))
            else:
                out.append(text)
            at += len(text)
        return "".join(out)

    def differs(self, text: str) -> bool:
        """Whether some place of the text looks like its plain form but is written with other characters."""
        if text.isascii():
            return any(c in text for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")
        if text != plain_text(text):
            return True
        for token in text.split(" "):
            if not token.isascii() and token not in self.forms:
                if skeleton(token) in self.by_skeleton:
                    return True
                # Unspaced text: look-alikes let more of it be cut into forms.
                if _is_unspaced(token) and "".join(p for p, _ in self._cut(token)) != token:
                    return True
        return False


#: The lexicon is read on the driver and sent to the executors as one broadcast; a larger one, which no language's list
#: of written forms reaches, is refused.
MAX_LEXICON = 1_000_000


def _lexicon(lexicon: DataFrame) -> list[tuple[int, str]]:
    return [(r[0], r[1]) for r in small_table(lexicon.select("lex_id", "form").filter("form is not null and lex_id is not null"), MAX_LEXICON)]


def is_lexicon_alike(words: DataFrame, word: str, lexicon: DataFrame) -> DataFrame:
    """words' rows whose word looks like a form of the lexicon, blanks at its edges aside, but is not equal to it, with
    lex_id and form (which take the place of columns of these names). Null and blank words never match. Of forms that
    look alike the first holds, of equal forms the least lex_id."""
    pairs = _lexicon(lexicon)
    spark = words.sparkSession
    known: dict[str, str] = {}
    for _, f in sorted(pairs):
        known.setdefault(skeleton(f), f)
    sent = spark.sparkContext.broadcast(known)
    forms = F.broadcast(spark.createDataFrame(pairs, "_lex_id int, _form string").groupBy("_form").agg(F.min("_lex_id").alias("_lex_id")))

    @F.pandas_udf("string")
    def spelled(s: pd.Series) -> pd.Series:
        return s.map(lambda w: unify_script(w, sent.value).strip(), na_action="ignore")

    odd = words.filter(F.col(word).isNotNull()).join(forms.select(F.col("_form").alias("_exact")), F.col(word) == F.col("_exact"), "left_anti")
    found = odd.withColumn("_plain", spelled(F.col(word))).join(forms, F.col("_plain") == F.col("_form"))
    return found.select(*[c for c in words.columns if c not in ("lex_id", "form")], F.col("_lex_id").alias("lex_id"), F.col("_form").alias("form"))


def differs_from_plain(lexicon: DataFrame) -> "callable":
    """A function Column -> BOOLEAN Column: Lexicon.differs of a text; false for null."""
    sent = lexicon.sparkSession.sparkContext.broadcast([f for _, f in _lexicon(lexicon)])
    made: list[Lexicon] = []

    @F.pandas_udf("boolean")
    def differs(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made[:] = [Lexicon(sent.value)]
        for s in it:
            yield s.map(lambda t: t is not None and made[0].differs(t)).astype("bool")

    return lambda c: differs(c)


def unify(texts: DataFrame, column: str, lexicon: DataFrame | None = None) -> DataFrame:
    """texts with the column in its consistent form (unify_text). ASCII texts stay in the JVM; nulls stay null."""
    sent = texts.sparkSession.sparkContext.broadcast(Lexicon([f for _, f in _lexicon(lexicon)]) if lexicon is not None else None)

    @F.pandas_udf("string")
    def united(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unify_text(t, sent.value), na_action="ignore")

    return texts.withColumn(column, F.when(is_ascii(F.col(column)) & ~F.col(column).rlike(r"[\t-\r\x1c-\x1f]"), F.col(column)).otherwise(united(F.col(column))))


def is_ascii(c: Column) -> Column:
    """Whether a text holds printable ASCII and blanks only."""
    return F.length(c) == F.octet_length(c)
