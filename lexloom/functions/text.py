"""Keys, splits and cleaning of spellings and glosses, as built-in column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: Stress marks and punctuation that aren't letters of a spelling.
STRESS = "'’‘`´ʼ,.;:!?\"()[]"
APOSTROPHES = "'’‘ʼʻ`´′"
#: Letter groups that are folded, in this order, before vowels and h are dropped from a phonetic key.
SKELETON_FOLDS = [
    ("gh", "h"), ("tch", "C"), ("thl", "L"), ("tlh", "L"), ("klh", "L"), ("tl", "L"), ("kl", "L"), ("dj", "C"), ("ch", "C"), ("sh", "s"),
    ("qu", "kw"), ("cw", "kw"), ("ck", "k"), ("ph", "f"), ("x", "ks"), ("j", "C"), ("c", "k"), ("ts", "z"), ("dz", "z"),
]
#: Words of a gloss that tell nothing.
GLOSS_STOP = (
    "a an the of to in on or and is it for with by at as be from that this one any some not also very used see same like make "
    "made being are was has have his her its their than up out"
).split()
STEM_SUFFIXES = ["ing", "ed", "es", "s", "ly"]
#: Part-of-speech abbreviations and what they stand for.
PARTS_OF_SPEECH = {
    "n": "n", "v": "v", "adv": "adv", "adj": "adj", "ad": "adj", "a": "adj", "udj": "adj", "interj": "interj", "inter j": "interj",
    "prep": "prep", "conj": "conj", "pron": "pron", "num": "num", "art": "art", "aux": "aux", "interrog": "interrog",
}
#: Order in which known notes of a row are written; `strict`, `line` and `ocr_page_index` are left out.
NOTE_ORDER = ["conf", "validated", "near", "single_source", "type", "section", "ditto", "ocr", "unverified_gloss", "ocr_gloss", "gloss_cleaned", "gloss_unverified", "gloss_state"]
HIDDEN_NOTES = ["strict", "line", "ocr_page_index"]


def _accent_table() -> tuple[str, str]:
    """(letters with marks, their base letters) of the Latin blocks, then combining marks, which translate() drops."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accent_table()


def _compatible_letters() -> dict[str, str]:
    """Characters beyond the Latin blocks that stand for Latin letters: ligatures, full-width and raised letters, and so on."""
    out = {}
    for code in range(0x250, 0x10000):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if plain != chr(code) and plain.isascii() and plain.isalpha():
            out[chr(code)] = plain
    return out


_COMPATIBLE = _compatible_letters()


def with_plain_letters(text: Column) -> Column:
    """Characters that stand for Latin letters as those letters; texts without any are left as they are."""
    # one literal that the optimizer makes a map of: a literal for each letter is hundreds of calls and nodes for the driver, in every key
    names = F.str_to_map(F.lit(",".join(f"{c}:{plain}" for c, plain in _COMPATIBLE.items())), F.lit(","), F.lit(":"))
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(names, c), c)), "")
    return F.when(text.rlike("[\u0250-\uffff]"), spelled).otherwise(text)


def without_accents(text: Column) -> Column:
    """Letters with marks as their base letters; combining marks dropped."""
    return F.translate(text, _ACCENTED, _PLAIN)


def latin(word: Column) -> Column:
    """Lower case, without stress marks, punctuation and accents."""
    return without_accents(F.translate(F.lower(F.trim(word)), STRESS, ""))


def headword_key(text: Column) -> Column:
    """The key under which spellings meet: a-z and single spaces only."""
    key = F.lower(without_accents(with_plain_letters(text)))
    for letter, plain in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        key = F.replace(key, F.lit(letter), F.lit(plain))
    key = F.translate(key, APOSTROPHES + "-.", "")
    return F.trim(F.regexp_replace(key, "[^a-z]+", " "))


def skeleton(text: Column) -> Column:
    """A coarse phonetic key: folded letter groups, no vowels or h, no letter twice in a row."""
    key = F.replace(headword_key(text), F.lit(" "), F.lit(""))
    key = reduce(lambda k, fold: F.replace(k, F.lit(fold[0]), F.lit(fold[1])), SKELETON_FOLDS, key)
    return F.regexp_replace(F.regexp_replace(key, "[aeiouyh]", ""), r"(.)\1+", "$1")


def word_key(text: Column) -> Column:
    """The letters a-z of a word, without case and accents."""
    return F.regexp_replace(without_accents(F.lower(text)), "[^a-z]", "")


def split_of(word: Column, test_share: float = 0.2, seed: str = "v0") -> Column:
    """'test' for about test_share of all words, the same for all spellings of a word: SHA-1 of seed and key, modulo 1000."""
    digest = F.sha1(F.concat(F.lit(seed), word_key(word)))
    # 16^26 and 16^13 modulo 1000 put the three parts of the 160-bit number together
    part = lambda start, size: F.conv(F.substring(digest, start, size), 16, 10).cast("bigint") % 1000
    rest = (part(1, 14) * (16**26 % 1000) + part(15, 13) * (16**13 % 1000) + part(28, 13)) % 1000
    return F.when(rest < test_share * 1000, "test").otherwise("train")


def gloss_tokens(gloss: Column) -> Column:
    """The distinct stems of the telling words of a gloss, in order."""
    words = F.regexp_extract_all(F.lower(gloss), F.lit("[a-z]+"), F.lit(0))
    stop = F.split(F.lit(" ".join(GLOSS_STOP)), " ")

    def stem(word: Column) -> Column:
        out = word
        for suffix in reversed(STEM_SUFFIXES):  # the first suffix that fits is cut off
            out = F.when((F.length(word) > len(suffix) + 2) & F.endswith(word, F.lit(suffix)), F.left(word, F.length(word) - len(suffix))).otherwise(out)
        return out

    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))
    return F.array_distinct(F.transform(kept, stem))


def squash(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain_quotes(text: Column) -> Column:
    """Typographic quotes and dashes as ASCII ones."""
    return F.translate(text, "’‘“”—–", "''\"\"--")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What `body` makes of a value, which is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def clean_gloss(text: Column, limit: int = 240) -> Column:
    """White space, quotes, broken words and outer punctuation put right; a long gloss is cut at its last break."""
    trimmed = F.regexp_replace(squash(plain_quotes(text)), r"\s+([,;.:!?])", "$1")
    trimmed = F.btrim(F.regexp_replace(trimmed, r"(?<=\w)- (?=[a-z])", ""), F.lit(" ;,.:-"))

    def cut(out: Column) -> Column:
        head = F.left(out, F.lit(limit))
        last = F.length(head) - F.length(F.regexp_extract(head, r"[^;, ]*\z", 0)) - 1
        short = F.when(last > limit // 2, F.left(head, last)).otherwise(head)
        return F.when(F.length(out) > limit, F.concat(F.btrim(short, F.lit(" ;,.:-")), F.lit(" ..."))).otherwise(out)

    return let(trimmed, cut)


def part_of_speech(raw: Column) -> Column:
    """Known abbreviations in a text, as a comma-joined list of distinct names."""
    names = F.create_map(*(F.lit(x) for pair in PARTS_OF_SPEECH.items() for x in pair))
    found = F.transform(F.split(F.lower(raw), r"[.,;\s]+"), lambda t: F.element_at(names, t))
    return F.array_join(F.array_distinct(F.filter(found, lambda x: x.isNotNull())), ",")


def well_formed(head: Column) -> Column:
    """Whether a headword could be one: 1 to 4 words of 2 to 18 letters with a vowel, no long run of consonants, no x first."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(head, r"\s*-\s*", "-"), r"\s+(?=['’])", "")), r"\s+")

    def fits(word: Column) -> Column:
        letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
        return (
            F.length(letters).between(2, 18)
            & word.rlike(r"^[A-Za-z][A-Za-z'’‘\-.]*\z")
            & letters.rlike("[aeiouy]")
            & ~letters.rlike("[bcdfgjkmnpqrstvxz]{4}")
            & ~F.startswith(letters, F.lit("x"))
        )

    return F.coalesce(F.size(words).between(1, 4) & F.forall(words, fits), F.lit(False))


def confidence(notes: Column) -> Column:
    """The grade in a row's notes, or A."""
    return F.coalesce(F.nullif(F.regexp_extract(notes, r"(?:^|;\s*)conf=([ABC])", 1), F.lit("")), F.lit("A"))


def cell_list(cell: Column, separator: str = "|") -> Column:
    """The parts of a list cell that aren't empty."""
    return F.filter(F.split(F.coalesce(cell, F.lit("")), "\\" + separator), lambda x: x != "")


def cell(value: Column) -> Column:
    """A value as one cell of a tab-separated file: one line, no tabs or backslashes."""
    return F.translate(squash(value.cast("string")), "\t\\", " /")


def note_text(notes: Column) -> Column:
    """A map of notes as `key=value; key=value`: known keys first in NOTE_ORDER, then the rest by key; empty ones left out."""
    shown = F.map_filter(notes, lambda k, v: v.isNotNull() & (v != "") & ~k.isin(HIDDEN_NOTES))
    order = F.array(*(F.lit(k) for k in NOTE_ORDER))
    keys = F.concat(F.filter(order, lambda k: F.map_contains_key(shown, k)), F.array_sort(F.array_except(F.map_keys(shown), order)))
    return F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.translate(squash(F.element_at(shown, k)), ";\t", ", "))), "; ")


def percent(part: Column, whole: Column) -> Column:
    """`part/whole = p%` with one decimal, half to even."""
    return F.format_string("%d/%d = %.1f%%", part, whole, F.bround(100.0 * part / F.greatest(whole, F.lit(1)), 1))  # half to even


def present(value: Column) -> Column:
    """The value, or null if it is empty."""
    return F.nullif(value, F.lit(""))
