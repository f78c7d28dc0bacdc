"""Scalar text functions over Columns: label predicates, normalisers, syllable and mora counts, token repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels that mark a pause, by strictness; labels of fillers without units; small kana without a mora.
PAUSE_BASIC = ("", "sp", "sil", "spn", "noise", "<sil>", "<sp>", "<spn>", "<p>", "<pause>", "breath", "<breath>")
PAUSE_EXTENDED = (*PAUSE_BASIC, "pause", "silb", "sile", "#", "...")
PAUSE_JA_BASELINE = (*PAUSE_BASIC, "pause", "silB", "silE", "#", "...")
FILLER_MARKERS = ("<filler_speech>", "<filler>", "filler_speech")
VOWELS = ("AA", "AE", "AH", "AO", "AW", "AX", "AXR", "AY", "EH", "ER", "EY", "IH", "IX", "IY", "OW", "OY", "UH", "UW", "UX")
SMALL_KANA = "ぁぃぅぇぉゃゅょゎァィゥェォャュョヮっッー"
# Japanese filler lexicons.
FILLERS_CONSERVATIVE = (
    "えっと", "えーと", "えと", "えっとー", "えーっと", "ええと", "ええっと", "えー", "あー", "うー", "うーん", "あのー", "そのー", "まあ", "まあまあ", "なんか", "なんていうか", "なんだっけ", "うん", "ええ", "はい", "ああ", "へー", "ふーん", "ね", "ねー", "ちょっと",
)
FILLERS_PERMISSIVE = (*FILLERS_CONSERVATIVE, "あの", "その", "あ", "え", "ん", "ま")
# Filler tokens put into gaps, by gap length in seconds.
GAP_FILLER_EN = "uh"
GAP_MIN, GAP_OFFSET, GAP_STEP, GAP_FILLERS_MAX = 0.4, 0.35, 0.55, 3

_EDGE_JA = r"[\s\x{3000}\x{3001}\x{3002}\x{ff0c}\x{ff0e}\x{ff01}\x{ff1f}\x{300c}\x{300d}\x{300e}\x{300f}\x{3008}\x{3009}\x{ff08}\x{ff09}.,!?\-\"'()]+"
_EDGE_SURFACE = r"[\s\x{3000}.,!?！？。、・「」『』()（）\[\]【】]+"


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """Lower case, runs of white space one space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def is_pause(label: Column, labels: tuple[str, ...] = PAUSE_BASIC) -> Column:
    """Whether a label marks a pause; null counts as blank. Labels in labels that aren't lower case never match."""
    return F.lower(strip(F.coalesce(label, F.lit("")))).isin(*labels)


def is_filler_marker(label: Column) -> Column:
    return F.lower(strip(F.coalesce(label, F.lit("")))).isin(*FILLER_MARKERS)


def syllables(word: Column) -> Column:
    """English syllables by vowel groups: one less for a final e where more than one, at least one."""
    w = F.lower(strip(word))
    n = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.greatest(n - F.when((n > 1) & w.endswith("e"), 1).otherwise(0), F.lit(1)).cast("int")


def moras(word: Column) -> Column:
    """Japanese units: characters that are neither small kana (long mark and geminate included) nor blank; at least one."""
    return F.greatest(F.length(F.regexp_replace(word, rf"(?U)[\s{SMALL_KANA}]", "")), F.lit(1)).cast("int")


def is_vowel_phone(label: Column) -> Column:
    """ARPAbet vowel: the part before a comma, stress digits and stars gone."""
    return F.upper(F.regexp_replace(F.split(label, ",")[0], r"[0-9*\s]", "")).isin(*VOWELS)


def aligner_token_en(c: Column) -> Column:
    t = F.regexp_replace(F.lower(strip(c)), r"^[^a-z0-9']+|[^a-z0-9']+$", "")
    return F.regexp_replace(t, "'+", "'")


def aligner_token_ja(c: Column) -> Column:
    return F.regexp_replace(strip(c), f"(?U)^{_EDGE_JA}|{_EDGE_JA}$", "")


def clean_word_en(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?U)^[^\w]+|[^\w]+$", "")
    return F.lower(F.regexp_replace(t, r"(?U)[^\w']", ""))


def clean_word_ja(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{_EDGE_JA}|{_EDGE_JA}$", "")


def compare_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"(?U)[^\w']", "")


def surface(c: Column) -> Column:
    """Surface form for lexicon look-up: wave dashes to the long mark, no spaces, no edge punctuation."""
    t = F.translate(F.lower(strip(F.coalesce(c, F.lit("")))), "〜～ 　", "ーー")
    return F.regexp_replace(t, f"^{_EDGE_SURFACE}|{_EDGE_SURFACE}$", "")


def in_filler_lexicon(c: Column, lexicon: tuple[str, ...]) -> Column:
    return surface(c).isin(*lexicon)


def gap_filler_count(gap: Column) -> Column:
    """Filler tokens for a gap of so many seconds."""
    k = F.floor((gap - F.lit(GAP_OFFSET)) / F.lit(GAP_STEP)) + 1
    return F.when(gap < GAP_MIN, 0).otherwise(F.least(F.greatest(k, F.lit(0)), F.lit(GAP_FILLERS_MAX))).cast("int")


def choose_filler(gap: Column, left: Column, right: Column, i: Column, pools: tuple[tuple[str, ...], ...], bounds: tuple[float, ...] = (0.8, 1.6)) -> Column:
    """Filler picked from the gap's pool by the sum of the code points of 'left|right|hundredths|i', so that runs agree."""
    sign = F.concat_ws("|", left, right, F.rint(gap * 100).cast("bigint").cast("string"), i.cast("string"))
    total = F.aggregate(F.transform(F.split(sign, ""), F.ascii), F.lit(0), lambda a, x: a + x)
    pick = lambda pool: F.element_at(F.array(*[F.lit(p) for p in pool]), (total % len(pool) + 1).cast("int"))
    out = pick(pools[-1])
    for pool, b in reversed(list(zip(pools, bounds))):
        out = F.when(gap < b, pick(pool)).otherwise(out)
    return out


def task_en(file_id: Column) -> Column:
    return F.when(file_id.contains("ST1"), "ST1").otherwise("ST2")


def task_ja(file_id: Column) -> Column:
    return F.when(file_id.contains("ST1"), "ST1").when(file_id.contains("ST2"), "ST2").otherwise("OTHER")


def file_stem(path: Column, suffixes: str = r"_vad_classifier|_ja_clauses|_clauses") -> Column:
    """File id of a path: directory, extension and known suffixes gone, whatever their case."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[A-Za-z]+$", ""), rf"(?i)({suffixes})$", "")


def metric_label(c: Column) -> Column:
    """'%.3f', 'NA' for null and NaN."""
    return F.when(c.isNull() | F.isnan(c), "NA").otherwise(F.format_string("%.3f", c))


def has_kanji(c: Column) -> Column:
    return c.rlike(r"[\x{4e00}-\x{9fff}]")


def to_hiragana(c: Column) -> Column:
    """Katakana letters as hiragana, by their distance of 0x60."""
    kata = "".join(map(chr, range(0x30A1, 0x30F7)))
    return F.translate(c, kata, "".join(chr(ord(k) - 0x60) for k in kata))


def mispronounce(reading: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """reading with the first rule that applies, applied to its first occurrence; null if none does."""
    out = F.lit(None).cast("string")
    for old, new in reversed(rules):
        at = F.instr(reading, old)
        out = F.when(at > 0, F.concat(F.substring(reading, F.lit(1), at - 1), F.lit(new), F.substring(reading, at + len(old), F.length(reading)))).otherwise(out)
    return out


def safe_div(a: Column, b: Column) -> Column:
    """a / b; NaN where b is not above 0."""
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(F.lit(float("nan")))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b; default where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))
