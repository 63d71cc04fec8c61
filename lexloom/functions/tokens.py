"""Spellings as token sequences: conversion, classes, rewrites and distances, as built-in column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import latin, let

# Fixed values.
#: token -> (code point of its sign or None, spellings)
TOKENS: dict[str, tuple[int | None, list[str]]] = {
    "P": (0x1BC02, ["p"]), "B": (0x1BC07, ["b"]), "T": (0x1BC03, ["t"]), "D": (0x1BC08, ["d"]), "F": (0x1BC04, ["f"]), "V": (0x1BC09, ["v"]),
    "K": (0x1BC05, ["k", "c"]), "G": (0x1BC0A, ["g"]), "L": (0x1BC06, ["l"]), "R": (0x1BC0B, ["r"]), "M": (0x1BC19, ["m"]), "N": (0x1BC1A, ["n"]),
    "SH": (0x1BC1B, ["sh"]), "S": (0x1BC1C, ["s", "z"]), "NG": (0x1BC22, ["ng"]), "CH": (0x1BC23, ["ch", "j", "tsh", "tch"]), "TS": (0x1BC25, ["ts"]),
    "TH": (0x1BC11, ["th"]), "DH": (0x1BC13, []), "KH": (0x1BC14, ["kh"]), "Q": (None, ["q"]), "KR": (None, ["kr"]), "HL": (0x1BC16, ["hl"]),
    "LH": (0x1BC17, ["lh"]), "RH": (0x1BC18, []), "H": (0x1BC00, ["h"]), "X": (0x1BC01, []),
    "A": (0x1BC41, ["a"]), "O": (0x1BC44, ["o"]), "OO": (0x1BC5B, ["oo"]), "OW": (0x1BC5A, ["ow"]), "E": (0x1BC46, ["e", "i", "y"]), "U": (0x1BC51, ["u", "iu", "yu", "yoo"]),
    "WA": (0x1BC5C, ["wa"]), "WO": (0x1BC5D, ["wo", "woe"]), "WE": (0x1BC5E, ["we", "wi"]), "WEYIE": (0x1BC5F, ["weyie"]), "WOW": (0x1BC60, ["wow"]),
    "WOO": (None, ["woo"]), "OWA": (None, ["owa"]), "WAY": (None, ["way"]), "WEEYA": (None, ["weeya"]),
    "|": (0x200C, []), "_": (0x20, []), "=": (0x1BC9F, []),
}
SPACE = "_"
#: Tokens that may stand twice in a row: vowels and the signs that start with w or owa.
REPEATABLE = ["A", "O", "OO", "OW", "E", "U", "WA", "WO", "WE", "WEYIE", "WOW", "WOO", "OWA", "WAY", "WEEYA"]
VOWELS = "aeiouy"
#: Spellings of an abbreviation that has the label `S T`.
ABBREVIATIONS = ["S.T.", "S.T"]

ALPHABET = [t for t in TOKENS if t not in ("|", "=")]
_SPELLINGS = {spelling: token for token, (_, spellings) in TOKENS.items() for spelling in spellings}
_LONGEST_FIRST = "|".join(map(re.escape, sorted(_SPELLINGS, key=len, reverse=True)))


def _mapped(names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))


def _split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s\-]+"), lambda w: w != "")


def _single(tokens: Column, of: Callable[[Column], Column] = lambda t: t) -> Column:
    """Doubled consonants as one token."""
    return F.filter(tokens, lambda t, i: (i == 0) | of(t).isin(REPEATABLE) | ~of(t).eqNullSafe(of(F.get(tokens, i - 1))))


def spell_word(word: Column, x_to_ks: bool = True, collapse: bool = True, w_alone: str = "OO") -> Column:
    """Tokens of one word by the longest spelling at each place; `aw` before no vowel is OW; what has no token is null."""
    letters = latin(word)
    if x_to_ks:
        letters = F.replace(letters, F.lit("x"), F.lit("ks"))
    pieces = F.regexp_extract_all(letters, F.lit(rf"(?s)aw(?![{VOWELS}])|{_LONGEST_FIRST}|."), F.lit(0))
    names = _mapped(_SPELLINGS | {"aw": "OW", "w": w_alone})
    tokens = F.transform(pieces, lambda p: F.element_at(names, p))
    return _single(tokens) if collapse else tokens


def spell(text: Column, unknown: str = "error", **options) -> Column:
    """Tokens of a text, its words joined by the space token. unknown: `error` stops at a character without a token, `null` gives null."""
    words = F.transform(_split_words(text), lambda w: spell_word(w, **options))
    joined = F.flatten(F.transform(words, lambda t, i: F.when(i == 0, t).otherwise(F.concat(F.array(F.lit(SPACE)), t))))
    bad = F.exists(joined, lambda t: t.isNull())
    if unknown == "null":
        return F.when(~bad, joined)
    return F.when(bad, F.raise_error(F.concat(F.lit("no token for a character in "), text)).cast("array<string>")).otherwise(joined)


def label(text: Column) -> Column:
    """The label `A B _ C` of a spelling, or null if it has a raised dot, is empty, or has a word that can't be spelled."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def part(word: Column) -> Column:
        return F.when(F.upper(word).isin(ABBREVIATIONS), "S T").otherwise(F.nullif(F.array_join(spell(word, unknown="null"), " "), F.lit("")))

    parts = F.transform(words, part)
    usable = ~F.contains(text, F.lit("·")) & (F.size(words) > 0) & F.forall(parts, lambda p: p.isNotNull())
    return F.when(usable, F.array_join(parts, f" {SPACE} "))


def to_signs(tokens: Column, missing: str = "�") -> Column:
    """The signs of the tokens as a string; a sign without a code point as `missing`."""
    signs = _mapped({t: chr(code) if code else missing for t, (code, _) in TOKENS.items()})
    return F.array_join(F.transform(tokens, lambda t: F.element_at(signs, t)), "")


def from_signs(text: Column) -> Column:
    """The tokens of a string of signs; other characters are dropped."""
    names = _mapped({chr(code): t for t, (code, _) in reversed(TOKENS.items()) if code})
    return F.filter(F.transform(F.split(text, ""), lambda c: F.element_at(names, c)), lambda t: t.isNotNull())


def classes(tokens: Column) -> Column:
    """1-based numbers of the tokens in the alphabet (0 is for a blank)."""
    alphabet = F.array(*(F.lit(t) for t in ALPHABET))
    return F.transform(tokens, lambda t: F.array_position(alphabet, t).cast("int"))


def in_alphabet(tokens: Column) -> Column:
    """Whether all tokens are in the alphabet."""
    return F.forall(tokens, lambda t: t.isin(ALPHABET))


def as_characters(tokens: Column) -> Column:
    """One ASCII character for each token, so that string functions work on tokens."""
    codes = _mapped({t: chr(ord("0") + i) for i, t in enumerate(TOKENS)})
    return F.array_join(F.transform(tokens, lambda t: F.element_at(codes, t)), "")


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance between token sequences."""
    return F.levenshtein(as_characters(a), as_characters(b))


def allowed_distance(length: Column) -> Column:
    """How far a part of so many tokens may be from a list word."""
    return F.when(length <= 2, 0).when(length <= 4, 1).otherwise(2)


def bounded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance, or most + 1 beyond it."""
    found = F.levenshtein(a, b, most)
    return F.when(found < 0, most + 1).otherwise(found)


def deletion_variants(text: Column, deletions: Column | int) -> Column:
    """All distinct strings with at most so many (0 to 2) characters deleted, the string itself first."""
    deletions = F.lit(deletions) if isinstance(deletions, int) else deletions

    def shorter(x: Column) -> Column:
        places = F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.left(x, i - 1), F.substring(x, i + 1, F.length(x))))

    none = F.array().cast("array<string>")
    once = F.when(deletions >= 1, shorter(text)).otherwise(none)
    twice = F.when(deletions >= 2, F.flatten(F.transform(F.array_distinct(once), shorter))).otherwise(none)
    return F.array_distinct(F.concat(F.array(text), once, twice))


SOURCED = "array<struct<token:string,letters:string,before:string,after:string>>"


def token_sources(word: Column) -> Column:
    """Each token with its letters and the letters beside them (`^` and `$` at the ends of a word), without the rule for `aw`."""

    def one(raw: Column) -> Column:
        letters = F.replace(latin(raw), F.lit("x"), F.lit("ks"))
        pieces = F.regexp_extract_all(letters, F.lit(f"(?s){_LONGEST_FIRST}|."), F.lit(0))
        names = _mapped(_SPELLINGS)

        def entry(piece: Column, i: Column) -> Column:
            start = F.length(F.array_join(F.slice(pieces, 1, i), ""))
            before = F.when(start == 0, "^").otherwise(F.substring(letters, start, 1))
            after = F.substring(letters, start + F.length(piece) + 1, F.lit(1))
            return F.struct(
                F.coalesce(F.element_at(names, piece), F.lit("OO")).alias("token"), piece.alias("letters"), before.alias("before"), F.when(after == "", "$").otherwise(after).alias("after")
            )

        return _single(F.transform(pieces, entry), lambda s: s.token)

    space = F.array(F.struct(F.lit(SPACE).alias("token"), F.lit(" ").alias("letters"), F.lit("").alias("before"), F.lit("").alias("after")))
    return F.flatten(F.transform(_split_words(word), lambda w, i: F.when(i == 0, one(w)).otherwise(F.concat(space, one(w)))))


def letter_class(letter: Column) -> Column:
    """V for a vowel, C for another letter, and the ends of a word as they are."""
    return F.when(letter.isin("^", "$", ""), letter).when(letter.isin(list(VOWELS)), "V").otherwise("C")


@dataclass(frozen=True)
class Rewrite:
    """Which entries of token_sources another spelling writes otherwise, and how.

    token, letters: of the entry; before, after, beside: whether the letter before, after, or on either side is a vowel;
    next: token and letters (or none) of the entry that follows; written: tokens that stand for the entry, and for the
    next one too if `both`; first: only the first such entry is rewritten; keeps: the new token keeps letters and neighbours.
    """

    token: str
    letters: tuple[str, ...] | None = None
    before: bool | None = None
    after: bool | None = None
    beside: bool | None = None
    next: tuple[str, str | None] | None = None
    written: tuple[str, ...] = ()
    both: bool = False
    first: bool = False
    keeps: bool = False

    def fits(self, entry: Column, follows: Column) -> Column:
        vowel = lambda letter: letter.isin(list(VOWELS))
        tests = [entry["token"] == self.token]
        if self.letters:
            tests.append(F.lower(entry["letters"]).isin(list(self.letters)))
        sides = [(self.before, vowel(entry["before"])), (self.after, vowel(entry["after"])), (self.beside, vowel(entry["before"]) | vowel(entry["after"]))]
        tests += [side if wanted else ~side for wanted, side in sides if wanted is not None]
        if self.next:
            tests += [follows["token"] == self.next[0]] + ([follows["letters"] == self.next[1]] if self.next[1] else [])
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))

    def __call__(self, sources: Column) -> Column:
        """The sources as the rule writes them."""
        fitting = F.transform(sources, lambda s, i: self.fits(s, F.get(sources, i + 1)))

        def written(hits: Column) -> Column:
            here = (lambda i: i + 1 == F.array_position(hits, True)) if self.first else (lambda i: F.get(hits, i))
            new = lambda s, t: F.struct(F.lit(t).alias("token"), *((s[c] if self.keeps else F.lit("")).alias(c) for c in ("letters", "before", "after")))
            none = F.array().cast(SOURCED)

            def entry(s: Column, i: Column) -> Column:
                out = F.when(here(i), F.array(*(new(s, t) for t in self.written)) if self.written else none)
                if self.both:
                    out = out.when((i > 0) & here(F.greatest(i - 1, F.lit(0))), none)
                return out.otherwise(F.array(s))

            return F.flatten(F.transform(sources, entry))

        return let(fitting, written)


# Rules by which words may have been spelled otherwise. The old rules undo later ones; the controls delete a
# sign that was surely written.
REWRITES: dict[str, Rewrite] = {
    "i_next_to_vowel_not_written": Rewrite("E", ("i", "y"), beside=True),
    "i_before_vowel_not_written": Rewrite("E", ("i", "y"), after=True),
    "i_after_vowel_not_written": Rewrite("E", ("i", "y"), before=True, after=False),
    "iu_is_U_alone": Rewrite("E", ("i",), next=("U", None)),
    "tsh_is_CH": Rewrite("TS", next=("H", "h"), written=("CH",), both=True),
    "tsh_is_TS_without_H": Rewrite("TS", next=("H", "h"), written=("TS",), both=True),
    "tsh_is_SH": Rewrite("TS", next=("H", "h"), written=("SH",), both=True),
    "z_is_TS (old rule)": Rewrite("S", ("z",), written=("TS",), keeps=True),
    "tsh_is_TS_H (old rule)": Rewrite("CH", ("tsh",), written=("TS", "H")),
    "tch_is_T_CH (old rule)": Rewrite("CH", ("tch",), written=("T", "CH")),
    "iu_yu_is_E_U (old rule)": Rewrite("U", ("iu", "yu"), written=("E", "U")),
    "yoo_is_E_OO (old rule)": Rewrite("U", ("yoo",), written=("E", "OO")),
    "control: drop an i with no vowel beside it": Rewrite("E", ("i",), before=False, after=False, first=True),
    "control: drop the first A": Rewrite("A", first=True),
    "control: drop the first O": Rewrite("O", first=True),
}
