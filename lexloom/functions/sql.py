"""The same keys as DuckDB SQL, for the oracles of the queries."""

from __future__ import annotations

from .text import APOSTROPHES, GLOSS_STOP, SKELETON_FOLDS, STEM_SUFFIXES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def headword_key(x: str) -> str:
    out = f"lower(strip_accents({x}))"
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        out = f"replace({out}, '{a}', '{b}')"
    out = f"regexp_replace({out}, {quoted('[' + APOSTROPHES + '.-]')}, '', 'g')"
    return f"trim(regexp_replace({out}, '[^a-z]+', ' ', 'g'))"


def folded(x: str) -> str:
    """Letter groups folded, vowels and h dropped; letters may still repeat."""
    out = f"replace({headword_key(x)}, ' ', '')"
    for a, b in SKELETON_FOLDS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"regexp_replace({out}, '[aeiouyh]', '', 'g')"


def collapsed(x: str) -> str:
    """No letter twice in a row. x: a column name."""
    return f"array_to_string(list_filter(string_split({x}, ''), lambda c, i: i = 1 OR c <> substr({x}, i - 1, 1)), '')"


def skeleton(x: str) -> str:
    """x: a column name or a short expression."""
    return collapsed(f"({folded(x)})")


def word_key(x: str) -> str:
    return f"regexp_replace(strip_accents(lower({x})), '[^a-z]', '', 'g')"


def split_of(x: str, share: float = 0.2, seed: str = "v0") -> str:
    digits = f"list_transform(string_split(sha1('{seed}' || {word_key(x)}), ''), lambda d: strpos('0123456789abcdef', d) - 1)"
    return f"CASE WHEN list_reduce({digits}, lambda a, d: (a * 16 + d) % 1000) < {share * 1000:g} THEN 'test' ELSE 'train' END"


def stem(x: str) -> str:
    cases = " ".join(f"WHEN length({x}) > {len(s) + 2} AND ends_with({x}, '{s}') THEN left({x}, length({x}) - {len(s)})" for s in STEM_SUFFIXES)
    return f"CASE {cases} ELSE {x} END"


def gloss_tokens(x: str) -> str:
    """A list of distinct stems; not in order."""
    stop = "[" + ", ".join(quoted(w) for w in GLOSS_STOP) + "]"
    kept = f"list_filter(regexp_extract_all(lower({x}), '[a-z]+'), lambda w: length(w) >= 3 AND NOT list_contains({stop}, w))"
    return f"list_distinct(list_transform({kept}, lambda t: {stem('t')}))"


def well_formed(x: str) -> str:
    words = f"string_split_regex(trim(regexp_replace({x}, '\\s*-\\s*', '-', 'g')), '\\s+')"
    letters = "regexp_replace(lower(w), '[^a-z]', '', 'g')"
    test = (
        f"length({letters}) BETWEEN 2 AND 18 AND regexp_full_match(w, {quoted("[A-Za-z][A-Za-z'’‘.-]*")}) AND regexp_matches({letters}, '[aeiouy]')"
        f" AND NOT regexp_matches({letters}, '[bcdfgjkmnpqrstvxz]{{4}}') AND NOT starts_with({letters}, 'x')"
    )
    return f"(len({words}) BETWEEN 1 AND 4 AND len(list_filter({words}, lambda w: NOT ({test}))) = 0)"


def aligned(ref: str, hyp: str) -> str:
    """The steps `a>b` of a shortest edit path of two lists of tokens, `-` for none; from its end a pair is preferred, then a lost token, then an added one.

    A row of the table of costs is a list of (cost, path so far), made from the row before by a list function.
    """
    hyps = f"list_transform({hyp}, lambda token_, place_: [{{'c': place_, 'p': token_}}])"
    first = f"list_reduce({hyps}, lambda row_, x_: list_append(row_, {{'c': x_[1].c, 'p': row_[-1].p || '->' || x_[1].p || ' '}}), [{{'c': 0::BIGINT, 'p': ''}}])"
    pair, lost, added = "up_[x_[1].c].c + (ref_[1].p <> x_[1].p)::INT", "up_[x_[1].c + 1].c + 1", "row_[-1].c + 1"
    paths = "up_[x_[1].c].p || ref_[1].p || '>' || x_[1].p || ' '", "up_[x_[1].c + 1].p || ref_[1].p || '>- '", "row_[-1].p || '->' || x_[1].p || ' '"
    cell = f"CASE WHEN {pair} <= least({lost}, {added}) THEN {{'c': {pair}, 'p': {paths[0]}}} WHEN {lost} <= {added} THEN {{'c': {lost}, 'p': {paths[1]}}} ELSE {{'c': {added}, 'p': {paths[2]}}} END"
    row = f"list_reduce({hyps}, lambda row_, x_: list_append(row_, {cell}), [{{'c': up_[1].c + 1, 'p': up_[1].p || ref_[1].p || '>- '}}])"
    last = f"list_reduce(list_transform({ref}, lambda token_: [{{'c': 0::BIGINT, 'p': token_}}]), lambda up_, ref_: {row}, {first})"
    return f"list_filter(string_split(({last})[-1].p, ' '), lambda step_: step_ <> '')"
